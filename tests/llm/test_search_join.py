"""Top-k search and the n-gram join against brute force."""

import random
from collections import Counter

import numpy as np
import pandas as pd
from conftest import ODD_TEXTS, docs_of
from pyspark.sql import functions as F

from kasaflow.llm import ngram_join, topk


def _brute_top(vectors, is_query, k):
    dim = max((len(v) for v in vectors.values()), default=0)
    q = {i: [int(np.floor(1024 * np.float64(x))) for x in v] + [0] * (dim - len(v)) for i, v in vectors.items()}
    out = set()
    for a in q:
        if is_query(a):
            best = sorted(((-sum(x * y for x, y in zip(q[a], q[b])), b) for b in q if b != a))[:k]
            out |= {(a, r + 1, b, -s) for r, (s, b) in enumerate(best)}
    return out


def _run(spark, rows, every, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return {tuple(r) for r in topk.top_k(df, F.col("vec_id") % every == 0, k=k, one_per_id=True).collect()}


def test_top_k_over_many_buckets_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(20, 8))
    rows = []
    for i in range(600):  # clusters, so that thresholds are high; lengths over three decades; many equal vectors
        v = base[i % 20] + 0.1 * rng.normal(size=8) if i % 5 else base[0]
        rows.append((i, [float(x) for x in v * 10 ** rng.uniform(-2, 1) ** (i % 3)]))
    assert _run(spark, rows, 40) == _brute_top(dict(rows), lambda a: a % 40 == 0, 5)


def test_top_k_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, []), (6, [3.0]),
            (8, [-1.0, 0.5, 7.0]), (10, [0.0, 0.0]), (11, [1e300, 1.0]), (None, [1.0, 1.0]), (6, [2.0]), (0, [1.0, 2.0]), (9, [1.0, 2.0])]
    good = {0: [1.0, 2.0], 5: [], 6: [2.0], 8: [-1.0, 0.5, 7.0], 10: [0.0, 0.0], 9: [1.0, 2.0]}
    assert _run(spark, rows, 2) == _brute_top(good, lambda a: a % 2 == 0, 5)
    assert _run(spark, [(1, None)], 1) == set() and _run(spark, [(0, [1.0])], 1) == set()


def _brute_pairs(rows, is_query, k):
    """As the query's SQL: every row is a vector, the rows of a query id share one ranking; exact integers."""
    q = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in rows]
    by: dict = {}
    for a, u in q:
        if is_query(a):
            by.setdefault(a, []).extend((-sum(x * y for x, y in zip(u, v)), b) for b, v in q if b != a)
    return sorted((a, r + 1, b, -s) for a, found in by.items()
                  for r, (s, b) in enumerate(sorted(x for x in found if -2 ** 63 <= -x[0] < 2 ** 63)[:k]))


def test_top_k_of_long_vectors_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 32)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(5)
    rows = [(i % 150, [float(x) for x in rng.normal(size=4) * 10.0 ** (i % 9)]) for i in range(300)]
    rows += [(400, [1.0, 2.0, 3.0, 4.0])] * 12 + [(401, [1e300, 0.0, 0.0, 0.0]), (410, [0.0, 1.0, 0.0, 0.0]),
                                                (2 ** 60, [5e6, 1.0, 0.0, 0.0]), (2 ** 60 + 2, [5e6, 1.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=5).collect()
    assert sorted(map(tuple, got)) == _brute_pairs(rows, lambda a: a % 10 == 0, 5)


def test_query_keeps_long_vectors_and_repeated_ids(spark, tmp_path):
    rows = [(0, [1.0, 0.5]), (100, [70_000.0, 1.0]), (1, [100_000.0, 0.0]), (1, [2.0, 2.0]), (2, [3.0, -1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = topk.op7_topk(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == _brute_pairs(rows, lambda a: a % 100 == 0, 10)


def test_pruning_never_loses_a_candidate():
    rng = np.random.default_rng(2)
    m = (rng.normal(size=(300, 6)) * rng.uniform(0.1, 3, (300, 1)) * 1000).astype(np.int32)
    b = topk.Bucket(np.arange(300, dtype=np.int64).tobytes(), m.tobytes(), 6)
    kept = total = 0
    for _ in range(200):
        q = (rng.normal(size=6) * 1000).astype(np.int32).astype(float)
        score = b.m @ q
        t = np.sort(score)[-rng.integers(1, 60)]
        rows = set(b.candidates(q, np.sqrt(q @ q), t).tolist())
        assert set(np.flatnonzero(score >= t).tolist()) <= rows
        kept, total = kept + len(rows), total + 300
    assert kept < 0.8 * total  # and it does prune


# ---- join ------------------------------------------------------------------------


def _sets(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(width)])) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()


def _brute_groups(rows, width, num, den):
    """Smallest id reachable, per text; all pairs."""
    texts = sorted({t or "" for _, t in rows})
    s = [_sets(t, width) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(texts)):
        for j in range(i):
            o = len(s[i] & s[j])
            if o and den * o >= num * (len(s[i]) + len(s[j]) - o):
                root[find(i)] = find(j)
    low = {}
    for d, t in rows:
        if d is not None:
            k = find(texts.index(t or ""))
            low[k] = min(low.get(k, d), d)
    return sorted((str(d), len(_sets(t, width)), str(low.get(find(texts.index(t or ""))) if _sets(t, width) else d)) for d, t in rows)


def _noisy(rng, words, rate):
    return [w if rng.random() > rate else f"e{rng.randrange(10 ** 6)}" for w in words]


def _corpus(seed, families=12, members=14):
    rng = random.Random(seed)
    rows, i = [], 1000
    for f in range(families):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randint(3, 120))]
        for _ in range(members):
            w = _noisy(rng, base, rng.choice([0, 0.004, 0.01, 0.03]))
            rows.append((i, rng.choice([" ", "\n", "  "]).join(w).upper() if rng.random() < 0.2 else " ".join(w)))
            i += rng.randint(1, 3)
    passage = " ".join(f"p{k}" for k in range(30))  # shared by many, linking none
    rows += [(i + k, " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(90)) + " " + passage) for k in range(40)]
    rng.shuffle(rows)
    return rows


def _groups(spark, rows, width, num, den):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.similar_groups(df, width=width, num=num, den=den).collect()
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got)


def test_join_equals_all_pairs(spark):
    rows = _corpus(1) + [(5, None), (6, ""), (7, " \n"), (8, "one two"), (9, "ONE  two"), (3, "one"), (9, "ONE  two"), (None, "one two"),
                         (None, "alone in null land here"), (11, "É è"), (12, "é è")]
    assert _groups(spark, rows, 3, 90, 100) == _brute_groups(rows, 3, 90, 100)


def test_join_with_many_blocks_and_bands(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "COLUMNS", 16)
    rows = _corpus(2, families=6, members=30)
    assert _groups(spark, rows, 5, 80, 100) == _brute_groups(rows, 5, 80, 100)


def test_join_of_exact_sets_and_wide_tokens(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "WIDE_FROM", 0)
    rows = _corpus(3, families=4)
    assert _groups(spark, rows, 3, 100, 100) == _brute_groups(rows, 3, 100, 100)


def test_product_equals_set_arithmetic(monkeypatch):
    monkeypatch.setattr(ngram_join, "COLUMNS", 8)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2 ** 60, 60).astype(np.uint64)
    sets = [np.unique(rng.choice(base, rng.integers(1, 60), replace=False)) for _ in range(40)]
    for num in (50, 70, 90):
        m = ngram_join.overlaps(sets[:25], sets[25:], num, 100)
        for i in range(25):
            for j in range(15):
                o = len(np.intersect1d(sets[i], sets[25 + j]))
                assert m[i, j] == (100 * o >= num * (len(sets[i]) + len(sets[25 + j]) - o))
    square = ngram_join.overlaps(sets, None, 50, 100)
    assert not square.diagonal().any() and (square == square.T).all()
    tree = ngram_join.forest(square, True)
    assert len(tree) == sum(square.any(1)) - len({min(np.flatnonzero(r)) if r.any() else -1 for r in np.linalg.matrix_power(
        (square | np.eye(40, dtype=bool)).astype(float), 40) > 0 if r.sum() > 1})


def test_join_with_classes_of_many_rows(spark):
    """A thousand repeated rows and a thousand copies without ids, and near copies among the classes after
    them: no block may share its name with another, or prefix n-grams go to the wrong texts."""
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    same, nameless = " ".join(words(700)), " ".join(words(700))
    rows = [(1, same)] * 1000 + [(None, nameless)] * 1000
    for f in range(100):
        base = words(60)
        rows += [(10 + 2 * f, " ".join(base)), (11 + 2 * f, " ".join(base[:-1] + ["end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    got = ngram_join.similar_groups(df, width=3, num=90, den=100).collect()
    assert len(got) == len(rows)
    name = {(r.doc_id, r.component_id) for r in got}
    assert name == {(1, 1), (None, None)} | {(10 + i, 10 + i - i % 2) for i in range(200)}


def test_texts_stay_where_they_are_read_until_components_are_known(spark, monkeypatch):
    """No exchange by class before the postings; copies in several tasks, and tasks that read the same rows."""
    plans, keep = {}, ngram_join.written

    def noting(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, name)
    monkeypatch.setattr(ngram_join, "written", noting)
    rows = _corpus(5, families=5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    again = df.union(df).union(df.selectExpr("doc_id + 50000", "text").repartition(3))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.similar_groups(again, width=3, num=90, den=100).collect())
    assert got == _brute_groups(rows + rows + [(d + 50000, t) for d, t in rows], 3, 90, 100)
    assert "hashpartitioning(bucket" in plans["join-prefixes"] and "hashpartitioning(cid" not in plans["join-prefixes"]


def test_ngrams_are_made_of_small_slices(spark, monkeypatch):
    packed, make = [], ngram_join.shingle_sets
    monkeypatch.setattr(ngram_join, "shingle_sets", lambda texts, width: (packed.append(sum(map(len, texts))), make(texts, width))[1])
    pdf = pd.DataFrame({"cc": 1, "cid": range(40), "least": 0, "band": 1, "members": 40, "sizes": None,
                        "text": [f"word{i} " * 8_000 for i in range(40)]})
    out = pd.concat(ngram_join._sets(3)(iter([pdf])))
    assert list(out["cid"]) == list(range(40)) and max(packed) <= 500_000 < sum(packed)


def test_one_of_each(spark):
    rows = _corpus(4, families=5) + [(5, None), (6, ""), (5, None), (None, "solo text without a number"), (None, "solo text without a number")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cid", F.lit("kept")).withColumn("id", F.lit(1))
    out = ngram_join.one_of_each(df)
    assert out.columns == df.columns
    groups = _brute_groups(rows, 5, 80, 100)
    want = sorted({g for d, n, g in groups if n and g != "None"} | {"None"}) + ["5", "5", "6"]
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(want)
    assert ngram_join.one_of_each(df.where("false")).count() == 0


def test_texts_of_clashing_class_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_class_id", lambda text: F.pmod(F.xxhash64(text), F.lit(7)))
    rows = _corpus(3, families=6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.similar_groups(df).collect()]
    want = [(str(d), n, str(g)) for d, n, g in _brute_groups(rows, 5, 80, 100)]
    assert sorted(got) == sorted(want)
    kept = [str(r.doc_id) for r in ngram_join.one_of_each(df).collect()]
    assert len([d for d, n, g in want if n and d == g]) == len([d for d, n, _ in want if n and d in kept])


def test_one_of_each_of_many_equal_rows(spark):
    """Rows of one id and text, and rows without an id: one stays of each group, and every row without words."""
    same, other = "one text that comes up again and again in the table", "quite another text that has rows of its own id only"
    df = docs_of(spark, [same, other, None, " "]).unionByName(
        spark.range(3000).selectExpr("CAST(NULL AS LONG) AS doc_id", f"IF(id % 3 = 0, '', '{same}') AS text", "'en' AS lang",
                                     "'s' AS source", "0L AS n_chars")).unionByName(
        spark.range(3000).selectExpr("1L AS doc_id", f"'{other}' AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars"))
    got = Counter((r.doc_id, (r.text or "").strip()) for r in ngram_join.one_of_each(df).collect())
    assert got == {(0, same): 1, (1, other): 1, (2, ""): 1, (3, ""): 1, (None, ""): 1000}


def test_odd_texts(spark):
    df = docs_of(spark, ODD_TEXTS, extra=True)
    got = {r.doc_id: r for r in ngram_join.similar_groups(df).collect()}
    assert all(got[i].component_id == i for i in range(len(ODD_TEXTS)))
    assert [got[i].n_shingles for i in range(4)] == [0, 0, 0, 1]
