"""The pipeline, stage by stage, against what each stage must do to its own input."""

import re

import corpus_pipeline
import pytest
from conftest import ODD_TEXTS, docs_of
from pyspark.sql import functions as F

from kasaflow.llm import mixing, ngram_join, quality
from kasaflow.llm.catalog import oracle_sql, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(f(spark, out[-1], SF), f"test-{name}"))
    return out


def test_stage_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontamination", "mixing", "sharding"]
    for frame in stages[1:5]:
        assert frame.columns == stages[0].columns
    assert stages[5].columns[:5] == stages[0].columns


def test_quality_stage_keeps_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    kept = stages[0].join(labels, "doc_id").join(stages[1].select("doc_id", F.lit(1).alias("kept")), "doc_id", "left").toPandas()
    assert kept[kept.quality == 1].kept.notna().mean() > 0.97
    assert kept[kept.quality == 0].kept.notna().mean() < 0.35


def test_one_document_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    from test_search_join import _sets
    by: dict = {}
    s = {d: _sets(t, 5) for d, t in rows}
    for d, x in s.items():
        for g in x:
            by.setdefault(g, []).append(d)
    root = {d: d for d in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                o = len(s[a] & s[b])
                if find(a) != find(b) and 100 * o >= 80 * (len(s[a]) + len(s[b]) - o):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(d for d in s if find(d) == d)


def test_leaks_go_and_only_they(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in stages[2].collect()}
    after = {r.doc_id for r in stages[3].collect()}
    leaking = {d for d, t in before.items() if any(x in t for x in items)}
    assert not leaking & after
    grams = {g for x in items for g in zip(*[re.findall(r"[^\W_]+", x.lower())[i:] for i in range(3)])}
    gone = set(before) - after - leaking
    assert all(sum(g in grams for g in zip(*[re.findall(r"[^\W_]+", before[d].lower())[i:] for i in range(3)])) >= 4 for d in gone)
    assert len(gone) <= 0.01 * len(before) + 1


def test_mix_takes_whole_documents_near_the_targets(stages):
    sizes: dict = {}
    for r in stages[3].collect():
        sizes.setdefault(r.source, []).append(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))
    want = mixing.targets({s: sum(v) for s, v in sizes.items()})
    got: dict = {}
    for r in stages[4].collect():
        got[r.source] = got.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert all(abs(got.get(s, 0) - want[s]) <= max(v) for s, v in sizes.items())


def test_shards_hold_all_rows(stages):
    rows = stages[5].collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stages[4].collect())
    slots: dict = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_run_is_the_stages_one_after_the_other(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "shard", "slot"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, stages[5].select(key).collect()))
    assert "pipeline" in queries() and "pipeline" not in oracle_sql()


def test_stages_take_odd_rows(spark):
    odd = docs_of(spark, ODD_TEXTS + ["same text of seven words for everyone"] * 3)
    odd = odd.withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.col("source")))
    odd = odd.unionByName(odd.where("doc_id = 3")).unionByName(odd.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    for docs in (odd, odd.where("false")):
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, docs, "/root/testdata/sf0.001")
            assert out.count() <= max(3 * docs.count(), 0), name
            assert name == "sharding" or out.columns == docs.columns


def test_quality_threshold_is_the_contracts():
    assert quality.THRESHOLD == 0.3 and ngram_join.similar_groups.__defaults__[2:] == (5, 80, 100)
