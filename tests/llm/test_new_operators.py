"""Spelling groups, line dedup and lexical search: brute force, odd inputs, many parts."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kasaflow.llm import lexical, line_dedup, spelling
from tests.llm.conftest import ODD_TEXTS, docs_of

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(words: dict[str, int]) -> dict:
    form, near = {}, {w: [o for o in words if one_edit(w, o)] for w in words}
    for w in words:
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def random_words(seed: int, n: int, letters: str) -> dict[str, int]:
    rng = random.Random(seed)
    words = {"".join(rng.choices(letters, k=rng.randint(5, 8))) for _ in range(n)}
    for w in list(words):
        at = rng.randrange(len(w))
        words |= {w[:at] + w[at + 1:] + "x", w[:at] + rng.choice(letters) + w[at:], w[:at] + "ÿ" + w[at + 1:]}
    return {w: rng.choice([3, 3, 4, 6, 12, 30, 500]) for w in words}


def spelled(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("subtree", [50_000, 40])
@pytest.mark.parametrize("letters", ["ab", "etaoinshrdlué"])
def test_spelling_groups_equal_brute_force_whole_and_in_many_parts(spark, letters, subtree):
    words = random_words(len(letters), 150, letters)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert spelled(spelling.spelling_groups(df, subtree=subtree)) == grouped(words)


def test_trie_meets_every_pair_one_code_point_apart():
    words = list(random_words(7, 120, "etaoé×"))
    packed = spelling.Words(words)
    trie, found = spelling.Trie(packed), []
    for query, leaf, unspent in trie.leaves(packed.counts):
        for q, w in trie.verified(query, leaf, packed):
            found += [(words[i], words[j]) for i, j in zip(q, w)]
            found += [] if unspent else [(words[j], words[i]) for i, j in zip(q, w)]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_leaves_keep_to_the_budget_of_one_surplus_and_then_one_deficit():
    words = spelling.Words(["eeeee", "eeeet", "eeett", "eeeeee", "eeetta", "ttttee"])
    trie = spelling.Trie(words)
    reached = {(int(q), int(trie.order[trie.leaf[n]])) for query, leaf, _ in trie.leaves(words.counts) for q, n in zip(query, leaf)}
    change = words.counts[None] - words.counts[:, None]
    first = np.take_along_axis(change, (change != 0).argmax(2)[..., None], 2)[..., 0]
    want = (np.maximum(change, 0).sum(2) <= 1) & (np.maximum(-change, 0).sum(2) <= 1) & (first >= 0)
    assert reached == {(int(i), int(j)) for i, j in zip(*np.nonzero(want))}


def test_long_words_and_chains_of_forms(spark):
    long = "a" * 30_000
    words = {long: 100, long[:-1] + "b": 10, long + "c": 10, "abcde": 3, "abcdf": 6, "abcgf": 12, "abhgf": 24, "aihgf": 48}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelled(spelling.spelling_groups(df))
    assert got == grouped(words) and got["abcde"][:2] == ("abcdf", "aihgf")


def test_vocabulary_of_odd_texts(spark):
    texts = ODD_TEXTS + ["Straße straße STRASSE ÉTÉÉÉ étééé"] * 300
    docs = docs_of(spark, texts, extra=True).withColumn("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")))
    want: Counter = Counter()
    for r in docs.collect():
        want += spelling.run_words("" if r.doc_id is None else str(r.doc_id), r.text or "")
    got = {r.word: r.n for r in spelling.vocabulary(docs).collect()}
    assert got == {w: n for w, n in want.items() if n >= 3} and {"straße", "strasse", "ÉtÉÉÉ"} <= set(got)


@pytest.mark.parametrize("query", ["spelling", "lines", "lexical"])
def test_empty_tables(spark, query):
    empty = docs_of(spark, ["x"]).limit(0)
    items = spark.createDataFrame([(1, "x")], "item_id long, text string")
    df = {"spelling": lambda: spelling.spelling_groups(spelling.vocabulary(empty)),
          "lines": lambda: line_dedup.drop_common_lines(empty),
          "lexical": lambda: lexical.rank_documents(empty, items)}[query]()
    assert df.collect() == []
    if query == "lexical":
        assert lexical.rank_documents(docs_of(spark, ["x"]), items.limit(0)).collect() == []


# ---- lines -------------------------------------------------------------------------------------

def key_of(line: str) -> str:
    return line.strip(" \t\n\x0b\x0c\r").translate(FOLD)


def kept(texts: list, min_docs: int, min_chars: int = 1) -> list[tuple]:
    split = [(t or "").split("\n") for t in texts]
    docs = Counter(k for lines in split for k in {key_of(x) for x in lines} if len(k) >= min_chars)
    out = []
    for lines in split:
        stay = [x for x in lines if docs.get(key_of(x), 0) < min_docs]
        out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def random_texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    pool = ["Common line", " common LINE\t", "ÉTÉ", "été", "", "  ", "\x0b\x0c", "tail\r"] + [f"line {i}" for i in range(40)]
    return ["\n".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("batches", [1, 5, 8])
def test_line_dedup_equals_brute_force(spark, batches):
    texts = ODD_TEXTS + random_texts(batches, 150) + ["a\nb\n" + "\n" * 5_000 + "Common line\n"]
    docs = docs_of(spark, texts, extra=True).withColumn("kept_text", F.lit("old"))
    rows = line_dedup.drop_common_lines(docs, min_docs=4, batches=batches).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_dropped, r.kept_text) for r in rows] == kept(texts, 4)
    assert [r.text for r in rows] == texts and "leaks" in rows[0].asDict()


def test_repeated_rows_and_rows_without_ids_are_documents(spark):
    docs = docs_of(spark, ["same\nown"] * 9).withColumn("doc_id", F.lit(None).cast("long")).unionAll(docs_of(spark, ["Same", "other"]))
    got = Counter((r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.drop_common_lines(docs, min_docs=10).collect())
    assert got == Counter(kept(["same\nown"] * 9 + ["Same", "other"], 10))


def test_short_keys_stay_and_hot_keys_beyond_the_share_are_found(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_KEYS", 3)  # only keys of a third of all pairs are broadcast
    texts = ["hot\nx\nwarm %d" % (i % 12) for i in range(120)]
    rows = line_dedup.drop_common_lines(docs_of(spark, texts), min_docs=10, min_chars=2).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_dropped, r.kept_text) for r in rows] == kept(texts, 10, 2)


def test_runs_are_merged_by_level_and_saturated_keys_are_not_counted_again(spark):
    def batch(lo, hi):
        return line_dedup.hashed(spark.range(lo, hi).select(F.col("id").cast("string").alias("_key")), "_key")

    runs = line_dedup.LineRuns(spark, saturated=2)
    for k in range(4):
        runs.add(batch(0, 10 + k))
        assert [r is not None for r in runs.levels] == [bool((k + 1) >> i & 1) for i in range((k + 1).bit_length())]
    counts = Counter(r.docs for r in runs.counts().collect())
    # two batches saturate a run: the third no longer counts keys 0 to 9; key 10 and later ones are counted anew
    assert counts[2] >= 10 and sum(counts.values()) == 13


def test_counts_of_runs_are_exact_below_saturation(spark):
    runs, want, rng = line_dedup.LineRuns(spark, saturated=100), Counter(), random.Random(1)
    for _ in range(8):
        ids = [rng.randrange(6) for _ in range(rng.randrange(0, 4))]
        want.update(ids)
        runs.add(line_dedup.hashed(spark.createDataFrame([(str(i),) for i in ids], "_key string"), "_key"))
        assert sorted(r.docs for r in runs.counts().collect()) == sorted(want.values())


def test_runs_are_read_without_a_shuffle(spark):
    def batch(lo, hi):
        return line_dedup.hashed(spark.range(lo, hi).select(F.col("id").cast("string").alias("_key")), "_key")

    runs = line_dedup.LineRuns(spark, saturated=10)
    for k in range(3):
        runs.add(batch(k, 50))
    plan = runs.counts()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Exchange" not in plan and plan.count("Bucketed: true") == 2


# ---- search ------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text) -> list[str]:
    return TERM.findall((text or "").translate(FOLD))


def ranked(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for i, text in items:
        found = []
        for d, c in counts:
            if c:
                m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                            for t in set(terms_of(text)) if c[t])
                if score > 0:
                    found.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("items_at_once", [2_000, 2])
def test_search_equals_brute_force_in_one_block_and_in_many(spark, monkeypatch, items_at_once):
    monkeypatch.setattr(lexical, "ITEMS_AT_ONCE", items_at_once)
    rng = random.Random(5)
    vocabulary = ["Alpha", "beta", "été", "ÉTÉ", "多语言", "x1", "a", "ab", "abc", "bc", "gamma"]
    texts = ODD_TEXTS + [rng.choice([" ", ", ", "\n", "_", "--"]).join(rng.choices(vocabulary, k=rng.randint(1, 30))) for _ in range(120)]
    ids = [None if i % 11 == 0 else i for i in range(len(texts))]
    docs = list(zip(ids, texts)) + [(5, texts[20]), (5, texts[20])]
    items = [(1, "ab abc beta"), (2, None), (3, "?!"), (None, "été alpha"), (4, "多语言"), (4, "x1 x1 X1"), (6, "absent"), (7, "word")]
    got = lexical.rank_documents(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS rank"),
                                 spark.createDataFrame(items, "item_id long, text string"), k=5).collect()
    assert Counter(map(tuple, got)) == Counter(ranked(docs, items, 5))


def test_automaton_counts_whole_terms_only():
    block = lexical.Block([(0, "ab"), (0, "b"), (1, "é"), (1, "ab")])
    got = lexical.count_terms(block.automaton(), lexical.fold("AB ab.abb b é éb b\x00b AB"))
    assert {block.terms[k]: n for k, n in got.items()} == {"ab": 3, "b": 3, "é": 1}
    assert lexical.n_terms(lexical.fold("AB ab.abb b é éb b\x00b AB")) == 9 and lexical.n_terms(lexical.fold(" . ")) == 0


def test_best_of_many_equal_scores_are_the_smallest_ids(spark):
    docs = docs_of(spark, ["same text"] * 3_000 + ["other words"] * 10_000).repartition(16)
    items = spark.createDataFrame([(1, "same")], "item_id long, text string")
    got = lexical.rank_documents(docs, items).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(10)) and len({r.score for r in got}) == 1


def test_sha_of_kept_text(spark, sf):
    got = {r.doc_id: r for r in line_dedup.op12_line_dedup(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    for r, (n, dropped, text) in zip(rows, kept([r.text for r in rows], 10)):
        g = got[r.doc_id]
        assert (g.n_lines, g.n_dropped, g.kept_sha256) == (n, dropped, hashlib.sha256(text.encode()).hexdigest())
