"""From raw documents to shards: quality, near copies, benchmark leaks, mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents. The first four return
the columns of ``documents``, the last adds the columns of the shards.

Defined cases are those of the operators: NULL and empty texts are scored like
any other by the quality model; they belong to no group of near copies and
leak nothing; the mix of words leaves rows without words out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kasaflow.llm import decontam, mixing, ngram_join, quality, sharding
from kasaflow.llm.common import fresh, table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "quality_score")
    return quality.with_quality(docs, model, column=score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word n-grams, Jaccard 0.8)."""
    return ngram_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = fresh(docs, "leaks")
    return decontam.with_leaks(docs, table(spark, sf_dir, "benchmark"), column=found).where(F.size(found) == 0).drop(found)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with size, text_crc32, law, shard, slot and grown_shard."""
    return sharding.shard_records(docs)


STAGES = [
    ("quality", keep_good),
    ("near_copies", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL = None  # trained models, hashes and walks: tested against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
