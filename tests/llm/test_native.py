"""Sharding and mixing against their laws, restated by brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

from conftest import ODD_TEXTS, docs_of
from pyspark.sql import functions as F

from kasaflow.llm import mixing, sharding


def _check_shards(rows, texts, shards):
    by = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 1 and r.law == "bytes" and r.grown_shard is None
        assert r.text_crc32 == (None if texts[r.doc_id] is None else zlib.crc32(raw))
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by.values())
    assert sum(map(len, by.values())) == len(texts)
    total = sum(r["size"] for r in rows)
    slack = max(r["size"] for r in rows) + 0.02 * total / shards
    for k in range(shards):
        assert abs(sum(r["size"] for r in by[k]) - total / shards) <= slack, k


def test_shards_are_near_equal_with_a_hot_group(spark):
    rng = random.Random(1)
    texts = ["copy " * 20] * 700 + ["".join(rng.choices("abc ", k=rng.randint(0, 400))) for _ in range(1400)] + ODD_TEXTS[:4]
    rows = sharding.shard_records(docs_of(spark, texts), carry=False).collect()
    _check_shards(rows, texts, 16)
    again = sharding.shard_records(docs_of(spark, texts).repartition(7), carry=False).collect()
    key = lambda r: (r.doc_id, r.shard, r.slot)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_small_groups_stay_together(spark):
    texts = [f"text number {i // 2} " + "x" * (i // 2 % 10) for i in range(8000)]  # groups below 1 % of a shard
    rows = sharding.shard_records(docs_of(spark, texts), carry=False).collect()
    at = defaultdict(set)
    for r in rows:
        at[texts[r.doc_id]].add(r.shard)
    assert max(map(len, at.values())) == 1


def test_shards_carry_columns_with_clashing_names(spark):
    df = docs_of(spark, ODD_TEXTS + ["same"] * 3, extra=True)
    df = df.unionByName(df.where("doc_id = 3"))  # a repeated row
    out = sharding.shard_records(df, shards=4)
    kept = [c for c in df.columns if c not in ("size", "shard")]
    assert sorted(map(str, out.select(kept).collect())) == sorted(map(str, df.select(kept).collect()))
    assert out.columns[-6:] == sharding.RESULT


def test_empty_tables(spark):
    none = docs_of(spark, ["x"]).where("false")
    assert sharding.shard_records(none).count() == 0
    assert sharding.shard_records(none, carry=False).count() == 0
    assert mixing.mix(none, carry=False).count() == 0
    assert mixing.mixed_documents(none).count() == 0


def test_targets_by_water_filling():
    got = mixing.targets({"a": 100, "b": 1000, "c": 10, None: 5})
    assert abs(sum(got.values()) - 1115) < 1e-9
    assert got["a"] == 300 and got["c"] == 30 and got[None] == 15 and got["b"] == 770
    assert mixing.targets({}) == {} and mixing.targets({"z": 0}) == {"z": 0.0}


def test_schedule_is_low_discrepancy_and_complete(spark):
    plan = [{"k": 0, "slots": 500, "lo": 0, "hi": 500}, {"k": 1, "slots": 300, "lo": 500, "hi": 800},
            {"k": 2, "slots": 0, "lo": 800, "hi": 800}, {"k": 3, "slots": 200, "lo": 800, "hi": 1000}]
    rows = sorted(mixing.schedule(spark, plan).collect(), key=lambda r: r.slot)
    by = defaultdict(list)
    for r in rows:
        by[r.k].append(r.rank)
    assert {k: sorted(v) for k, v in by.items()} == {0: list(range(500)), 1: list(range(300)), 3: list(range(200))}
    for upto in (50, 200, 700):  # every stretch of the schedule is mixed
        seen = Counter(r.k for r in rows if r.slot < upto)
        assert all(abs(seen[k] - upto * s / 1000) <= 6 for k, s in ((0, 500), (1, 300), (3, 200)))


def test_mix_equals_the_unrolled_line(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 900]))) if i % 17 else None,
             rng.choice(["a"] * 6 + ["b", "c", "é", None]), i) for i in range(900)]
    rows += [rows[5], rows[5]]  # repeated rows
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mixing.mix(df, block=64).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = mixing.targets(dict(sizes))
    taken = Counter()
    for r in got:
        n = len((r.text or "").split())
        assert r["size"] == n and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * n
        assert abs(r.target - want[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-9 for s in want)
    # within a source a document's share differs by at most one epoch
    for s in sizes:
        full = [r.taken / r["size"] for r in got if r.source == s and r["size"]]
        assert not full or max(full) - min(full) <= 1 + 1e-9


def test_mixed_documents_repeat_rows(spark):
    rows = [(i, "w " * 10, "a") for i in range(200)] + [(1000 + i, "w " * 10, "b") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_doc", F.lit(1))
    got = Counter(r.doc_id for r in mixing.mixed_documents(df).collect())
    assert max(got.values()) <= 3 and sum(v for k, v in got.items() if k >= 1000) == 60


def test_many_equal_rows_are_dealt_over_ranges(spark, monkeypatch):
    seen = []
    real = sharding.written

    def watched(df, name):
        out = real(df, name)
        seen.append((name, out))
        return out
    monkeypatch.setattr(sharding, "written", watched)
    df = spark.range(30_000).selectExpr(
        "IF(id % 2 = 0, 7L, id) AS doc_id", "IF(id % 2 = 0, 'the same row', concat('text ', id)) AS text", "id % 5 AS extra").repartition(6)
    out = sharding.shard_records(df)
    rows = out.collect()
    assert Counter((r.doc_id, r.text, r.extra) for r in rows) == Counter((r.doc_id, r.text, r.extra) for r in df.collect())
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by.values())
    total = sum(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in part) - total / 16) <= 0.02 * total / 16 + 40 for part in by.values())
    # 15,000 equal rows come in 15 batches with a tie-break each, so their sub-ranges hold a batch or two
    placed = dict(seen)["shard-placed"]
    ties = [r["count"] for r in placed.where("_id = 7 AND size = 13").groupBy("_tie").count().collect()]
    assert sorted(ties) == [1000] * 15
    cells = dict(seen)["shard-cells"].where("_sub LIKE 'k%'").count()
    assert cells >= 10


def test_rows_without_ids_have_many_order_keys_and_equal_the_sql(spark, tmp_path):
    import duckdb

    from kasaflow.llm.sql import MIXING

    df = spark.range(40_000).selectExpr(
        "IF(id % 3 = 0, id, NULL) AS doc_id", "IF(id % 9 = 1, NULL, repeat('w ', CAST(id % 2 + 1 AS INT))) AS text",
        "IF(id % 4 < 3, 'a', NULL) AS source")
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op4_mixing(spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = db.execute(MIXING).fetchall()
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert len({r.taken for r in got if r.doc_id is None and r["size"] == 2}) > 1  # the cut falls among rows alike
    mixed = mixing.mixed_documents(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert mixed.columns == df.columns and mixed.count() > 0


def test_batches_number_the_copies_exactly(spark):
    from kasaflow.llm.common import COPIES, with_batch, written

    df = spark.range(12_000).selectExpr("IF(id % 4 > 0, NULL, id) AS a", "IF(id % 2 = 0, 'x', NULL) AS b")
    df = written(df.repartition(7).withColumn("at", F.monotonically_increasing_id()), "batches")
    got = Counter((r.a, r.b, r.batch) for r in with_batch(df, ["a", "b"], "at", "batch").collect())
    want = Counter()
    for (a, b), n in Counter((r.a, r.b) for r in df.collect()).items():
        for i in range(n):
            want[a, b, i // COPIES] += 1
    assert got == want
