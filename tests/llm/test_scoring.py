"""Quality, toxicity and language models: method details and held-out accuracy."""

import numpy as np
import pytest
from conftest import ODD_TEXTS, docs_of
from pyspark.sql import functions as F

from kasaflow.llm import langid, quality, toxicity
from kasaflow.llm.catalog import queries


def _held_out(spark, sf, name, label):
    got = queries()[name](spark, sf)
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").where("held_out").select("score", "predicted", label).toPandas()
    assert ((rows.score >= 0) & (rows.score <= 1)).all()
    bucket = docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("h"))
    assert got.join(bucket, "doc_id").where("held_out <> h").count() == 0
    return rows


def _auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_quality_on_held_out_rows(spark):
    rows = _held_out(spark, "/root/testdata/sf0.01", "op10_quality", "quality")
    assert _auc(rows.quality.to_numpy(), rows.score.to_numpy()) > 0.97
    assert (rows.predicted == (rows.score >= 0.3)).all()
    assert (rows[rows.quality == 1].predicted == 1).mean() > 0.97


def test_toxicity_on_held_out_rows(spark):
    rows = _held_out(spark, "/root/testdata/sf0.1", "op2_toxicity", "toxic")
    assert _auc(rows.toxic.to_numpy(), rows.score.to_numpy()) > 0.9  # some labels of this table mark texts without a toxic word
    assert (rows[rows.toxic == 0].predicted == 0).mean() > 0.95 and (rows[rows.toxic == 1].predicted == 1).mean() > 0.8
    assert (rows.predicted == (rows.score >= 0.5)).all()


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries()["op8_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").toPandas()
    held = got[got.held_out & got.lang.notna()]
    assert len(held) > 150 and (held.lang_pred == held.lang).mean() > 0.95
    assert ((got.score >= 0) & (got.score <= 1)).all()


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(0)
    X = rng.uniform(size=(4000, 4))
    y = ((X[:, 0] > 0.5) ^ (X[:, 2] > 0.5)).astype(float)  # no single feature tells
    m = quality.train(X, y)
    assert (0, 2) in [(i, j) for i, j, _ in m["pairs"]]
    assert ((quality.predict(m, X) > 0.5) == y).mean() > 0.9


def test_additive_score_is_the_sum_of_table_entries():
    rng = np.random.default_rng(1)
    X = rng.normal(size=(500, 3))
    m = quality.train(X, (X[:, 1] > 0).astype(float))
    for x, p in zip(X[:20], quality.predict(m, X[:20])):
        bins = [np.searchsorted(e, v, "right") for e, v in zip(m["edges"], x)]
        s = m["bias"] + sum(t[b] for t, b in zip(m["tables"], bins))
        cell = lambda i: min(bins[i] * quality.PAIR_BINS // len(m["tables"][i]), quality.PAIR_BINS - 1)
        s += sum(t[cell(i), cell(j)] for i, j, t in m["pairs"])
        assert p == pytest.approx(1 / (1 + np.exp(-s)))


def test_features_match_plain_counting():
    texts = ["One two two. THREE!", "a|b | c", "", None, "x\nx\ny"]
    got = dict(zip(quality.FEATURES, quality.text_features(texts).T))
    assert got["words"] == pytest.approx(np.log1p([4, 3, 0, 0, 3]))
    assert got["upper"][0] == pytest.approx(6 / 14)
    assert got["distinct_words"] == pytest.approx([1, 1, 0, 0, 2 / 3])
    assert got["distinct_lines"][4] == pytest.approx(2 / 3)
    assert got["same_as_previous"][4] == pytest.approx(1 / 3)
    one_by_one = np.concatenate([quality.text_features([t]) for t in texts])
    assert np.array_equal(one_by_one, quality.text_features(texts))


def test_gru_gradients_match_differences():
    rng = np.random.default_rng(0)
    vocab = ["ab", "cde", "fghi", "idiot", "xx"]
    texts = [" ".join(rng.choice(vocab, size=int(rng.integers(0, 60)))).encode() for _ in range(6)]
    y, w = np.array([1, 0, 1, 0, 1, 0.0]), np.ones(6)
    m = {k: v.astype(np.float64) for k, v in toxicity.new_model().items()}
    e = toxicity.Encoded(texts)
    _, g = toxicity.gradients(m, e, y, w)
    for k in ("out", "att", "bias", "Uf", "Ub", "Wf", "Wb", "cf", "cb"):
        at = np.unravel_index(int(np.argmax(np.abs(g[k]))), g[k].shape)
        old, eps = m[k][at], 1e-2
        m[k][at] = old + eps
        up = toxicity.gradients(m, e, y, w)[0]
        m[k][at] = old - eps
        down = toxicity.gradients(m, e, y, w)[0]
        m[k][at] = old
        assert (up - down) / (2 * eps) == pytest.approx(g[k][at], rel=2e-2, abs=1e-7), k


def test_a_window_starts_at_every_word():
    words = [f"w{i}" for i in range(100)]
    e = toxicity.Encoded([" ".join(words).encode(), b"", b"one", " ".join(words[:toxicity.WINDOW]).encode()])
    assert list(np.bincount(e.window_text)) == [101 - toxicity.WINDOW, 1, 1, 1]
    assert (e.windows[:101 - toxicity.WINDOW] == e.line[np.arange(101 - toxicity.WINDOW)[:, None] + np.arange(toxicity.WINDOW)]).all()
    for shift in range(toxicity.TRAIN_STRIDE):  # training: fewer, from another start each time, all words covered
        t = toxicity.Encoded([" ".join(words).encode(), b"one"], toxicity.TRAIN_STRIDE, shift)
        mine = t.windows[t.window_text == 0]
        assert len(np.unique(mine)) == 100 and len(mine) < 25 and (t.window_text == 1).sum() >= 1


def _plain_logit(m, e, window):
    """One window, word by word."""
    x = toxicity.inputs(m, e)
    sig = lambda v: 1 / (1 + np.exp(-v))
    H, states = toxicity.HIDDEN, {}
    for d, order in (("f", range(len(window))), ("b", reversed(range(len(window))))):
        h = np.zeros(H)
        for t in order:
            if window[t]:
                a, u = x[window[t]] @ m[f"W{d}"] + m[f"c{d}"], h @ m[f"U{d}"]
                z, r = sig(a[:H] + u[:H]), sig(a[H:2 * H] + u[H:2 * H])
                n = np.tanh(a[2 * H:] + r * u[2 * H:])
                h = (1 - z) * n + z * h
            states[d, t] = h
    s = [np.concatenate((states["f", t], states["b", t])) for t in range(len(window))]
    att = np.array([v @ m["att"] if window[t] else -30.0 for t, v in enumerate(s)])
    w = np.exp(att - att.max())
    return float((w / w.sum()) @ np.array(s) @ m["out"] + m["bias"][0])


def test_window_logits_equal_a_plain_network_window_by_window(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    rng = np.random.default_rng(4)
    vocab = ["ab", "cde", "fghi", "idiot", "xx", "é", "12"]
    texts = [" ".join(rng.choice(vocab, size=k)).encode() for k in (0, 1, 5, 12, 13, 40)]
    m, e = toxicity.new_model(), toxicity.Encoded(texts)
    got = toxicity.window_logits(m, e)[e.starts]
    assert got == pytest.approx([_plain_logit(m, e, w) for w in e.windows], abs=1e-4)
    top = [max(g for g, t in zip(got, e.window_text) if t == k) for k in range(len(texts))]
    assert toxicity._text_logits(m, texts) == pytest.approx(top)


def test_the_score_does_not_depend_on_where_a_passage_starts():
    rng = np.random.default_rng(5)
    clean = [" ".join(rng.choice(["the", "of", "and", "reth", "onan", "tion"], 40)) for _ in range(300)]
    m = toxicity.train(clean + [t + " you moronic fool" for t in clean[:150]], np.array([0] * 300 + [1] * 150))
    passage = clean[0] + " you moronic fool " + clean[1]
    scores = toxicity.text_scores(m, [" ".join((clean[2] + " " + clean[3]).split()[:k]) + " " + passage for k in range(25)])
    assert np.ptp(scores) < 1e-5 and scores.min() >= 0.5


def test_long_labelled_texts_are_cut_in_pieces_and_classes_stay(spark):
    long = "word " * 20_000
    cut = toxicity.pieces(long)
    assert len(cut) <= toxicity.LONGEST + 20 and toxicity.pieces("é" * 100) == "é" * 100
    docs = docs_of(spark, [long + "good"] * 30 + ["moronic " * 9_000] * 30)
    labels = docs.selectExpr("doc_id", "cast(doc_id >= 30 as int) AS toxic")
    m = toxicity.fit(docs, labels)
    low, high = toxicity.text_scores(m, [long, "moronic " * 50])
    assert low < 0.5 <= high


def test_the_label_sample_has_one_row_an_id_and_keeps_its_bound(spark):
    docs = docs_of(spark, [f"t{i}" for i in range(400)]).unionAll(docs_of(spark, ["same"] * 3_000).withColumn("doc_id", F.lit(7).cast("long")))
    labels = docs_of(spark, ["x"] * 400).selectExpr("doc_id", "cast(doc_id % 4 = 0 as int) AS toxic")
    for balanced, most in ((False, 100), (True, 60)):
        got = quality.labelled_sample(docs, labels, "toxic", most, balanced=balanced).toPandas()
        assert len(got) == most and got.doc_id.is_unique
        again = quality.labelled_sample(docs.repartition(7), labels.repartition(3), "toxic", most, balanced=balanced).toPandas()
        assert sorted(map(tuple, got.values)) == sorted(map(tuple, again.values))
        assert not balanced or got.y.sum() == 30
    whole = quality.labelled_sample(docs, labels, "toxic", 10_000).toPandas()
    assert len(whole) == labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).count()


def test_a_toxic_word_at_the_end_of_a_long_text_counts():
    rng = np.random.default_rng(3)
    clean = [" ".join(rng.choice(["the", "of", "and", "reth", "onan", "tion"], 40)) for _ in range(300)]
    texts = clean + [t + " moronic" for t in clean[:150]]
    m = toxicity.train(texts, np.array([0] * 300 + [1] * 150))
    long = " ".join(clean[:200])
    low, high = toxicity.text_scores(m, [long, long + " moronic"])
    assert low < 0.5 <= high


def test_mixture_finds_both_languages():
    docs = {"en": b"the quick brown fox and the lazy dog with the others there ", "xx": b"zok vrak plim zork vlim plok zzav krizz "}
    c = np.stack([langid.gram_counts([d * 20]) for d in docs.values()])
    model = {"langs": list(docs), "logp": np.ascontiguousarray((np.log(c + 1) - np.log(c.sum(1, keepdims=True) + c.shape[1])).T.astype(np.float32))}
    mixed = (docs["en"] * 6 + docs["xx"] * 3).decode()
    lang, score = langid.predict(model, [mixed, docs["xx"].decode(), "123 !!", None, "", "plim"])
    assert lang == ["en", "xx", "und", "und", "und", "xx"]
    assert 0.5 < score[0] < 0.85 and score[1] == 1.0 and list(score[2:5]) == [0, 0, 0]


def test_em_equals_plain_em():
    rng = np.random.default_rng(5)
    ll, w = rng.normal(size=(9, 3)), rng.integers(1, 4, 9).astype(float)
    share, value, _ = langid.em(ll, w, np.array([0]), np.zeros(9, int), np.ones((1, 3), bool))
    p = np.full(3, 1 / 3)
    for _ in range(langid.ITERATIONS):
        r = np.exp(ll) * p
        r = r / r.sum(1, keepdims=True) * w[:, None]
        p = r.sum(0) / w.sum()
    assert share[0] == pytest.approx(p, rel=1e-6)
    assert value[0] == pytest.approx((w * np.log((np.exp(ll) * p).sum(1))).sum(), rel=1e-6)


def test_odd_texts_empty_tables_and_clashing_names(spark):
    df = docs_of(spark, ODD_TEXTS, extra=True)
    df = df.unionByName(df.where("doc_id = 3"))
    none = df.where("false")
    q = quality.fit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    t = toxicity.fit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    g = langid.fit(none)
    for f in (lambda d: quality.with_quality(d, q, column="out"), lambda d: toxicity.with_toxicity(d, t, column="out")):
        assert f(none).count() == 0
        assert {r.out for r in f(df).collect()} == {0.5}
        assert f(df).drop("out").columns == df.columns
    assert langid.with_language(none, g).count() == 0
    assert {r.language.lang_pred for r in langid.with_language(df, g).collect()} == {"und"}
    m = langid.fit(docs_of(spark, ["the cat", "the dog"], start=100))
    got = {r.doc_id: r.language for r in langid.with_language(df, m).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[5].lang_pred == "und" and got[3].lang_pred == "en"


def test_labels_are_bounded_and_null_safe(spark):
    docs = docs_of(spark, [f"text {i}" for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(400)] + [(None, 1, 1), (7, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = quality.labelled_sample(docs, labels, "quality", 100).collect()
    assert 40 < len(got) < 180 and all(r.y in (0, 1) for r in got)
    import zlib
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)
    assert len(quality.labelled_sample(docs, labels, "toxic", 100).collect()) <= 1
