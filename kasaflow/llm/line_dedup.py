"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

A line's key is the line without ASCII white space at its ends, A-Z in lower
case. Keys of ``min_chars`` code points or more that occur in ``min_docs``
documents or more lose all their lines; the other lines stay, joined by \\n.

``LineRuns`` keeps how many documents hold each key as sorted runs: tables
bucketed and sorted by the key's hash (128 bits). A batch of documents is
counted, merge-anti-joined with the keys that a run already knows to be common
(they need no more counting), and becomes a run of its own; runs of one level
are merged into one of the next, as a binary counter carries. All runs share
one bucketing, so anti-joins and merges read them bucket by bucket and sorted,
without a shuffle; a batch shuffles once, after counting on the map side.

Then every document's lines meet the common keys. Keys that hold more than
1 / HOT_KEYS of all counted (document, key) pairs, at most HOT_KEYS of them,
are broadcast; the others join by key, and the places of the lines to drop go
back to their documents by row number.

Defined cases: NULL or empty text is one empty line and stays; blank lines have
an empty key and always stay; every row is a document, also repeated rows and
rows with NULL or equal ids; a document that loses all lines keeps an empty
text; texts of any length are read whole; an empty table gives an empty
result; other columns are carried, and added columns replace same-named ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kasaflow.llm.common import table
from kasaflow.session import ensure_checkpoint_dir

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 8
HOT_KEYS = 10_000
KEY = ["_k1", "_k2"]
RESULT = ["n_lines", "n_dropped", "kept_text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENDS = " \t\n\x0b\x0c\r"


def line_keys(text: Column) -> Column:
    """Array of the keys of a text's lines, in order."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)  # ASCII: lower() touches A-Z alone and is quicker
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.transform(F.split(low, "\n", -1), lambda line: F.btrim(line, F.lit(ENDS)))


def hashed(df: DataFrame, key: str) -> DataFrame:
    """``df`` with two 64-bit hashes of the column ``key`` (seeds apart) in its place."""
    return df.withColumn(KEY[0], F.xxhash64(key)).withColumn(KEY[1], F.xxhash64(F.lit(1), F.col(key))).drop(key)


class LineRuns:
    """How many documents hold each line key, as levelled sorted runs.

    ``saturated``: a key that one run has seen in so many documents is common
    for good and is no longer counted; its count is then a lower bound."""

    def __init__(self, spark: SparkSession, saturated: int = MIN_DOCS):
        self.spark, self.saturated = spark, saturated
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[DataFrame | None] = []

    def live(self) -> list[DataFrame]:
        return [run for run in self.levels if run is not None]

    def _sorted_run(self, df: DataFrame) -> DataFrame:
        """Write a run under the shared folder; the catalog forgets its name again at once."""
        name = f"line_run_{uuid.uuid4().hex}"
        (df.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY)
         .option("path", f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/{name}").saveAsTable(name))
        run = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return run

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Runs as one, in a merge join: a union of bucketed tables is not safe to group by the bucket
        columns in Spark 4.1 (it may give up one table's buckets after it dropped the shuffle)."""
        out = runs[0]
        for run in runs[1:]:
            out = (out.join(run.withColumnRenamed("docs", "_more"), KEY, "full")
                   .select(*KEY, (F.coalesce("docs", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("docs")))
        return out

    def add(self, keys: DataFrame) -> None:
        """Add a batch: one row a (document, key), hashed."""
        new = keys.groupBy(*KEY).agg(F.count("*").alias("docs"))
        for run in self.live():
            new = new.join(run.where(F.col("docs") >= self.saturated).select(*KEY), KEY, "left_anti")
        level, parts = 0, [new]
        while level < len(self.levels) and self.levels[level] is not None:
            parts.append(self.levels[level])
            self.levels[level] = None
            level += 1
        run = self._sorted_run(self._merged(parts))
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = run

    def counts(self) -> DataFrame | None:
        """(key, docs) of all runs, one row a key (None before the first batch)."""
        return self._merged(self.live()) if self.live() else None


def numbered(df: DataFrame, text: str, batches: int, carry: bool, doc_id: str) -> DataFrame:
    """Rows with a number and a batch, written once: later passes agree on both."""
    rows = df.select(*([F.struct(*df.columns).alias("_doc")] if carry else [F.col(doc_id).alias("_doc")]),
                     F.col(text).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumn("_batch", F.pmod(F.xxhash64("_row"), F.lit(batches)).cast("int"))
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/line-rows-{uuid.uuid4().hex}"
    rows.write.partitionBy("_batch").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def drop_common_lines(df: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                      batches: int = BATCHES, doc_id: str = "doc_id", carry: bool = True) -> DataFrame:
    """Columns of ``df`` (or only the id) plus n_lines, n_dropped, kept_text."""
    spark = df.sparkSession
    df = df.drop(*RESULT)
    rows = numbered(df, text, batches, carry, doc_id)
    long_enough = F.char_length("_key") >= max(min_chars, 1)

    runs = LineRuns(spark, min_docs)
    for b in range(batches):
        batch = rows.where(F.col("_batch") == b).select(F.explode(F.array_distinct(line_keys(F.col("_text")))).alias("_key"))
        runs.add(hashed(batch.where(long_enough), "_key"))
    counts = runs.counts()
    common = counts.where(F.col("docs") >= min_docs)

    # docs adds up to the number of counted pairs, so at most HOT_KEYS keys reach this share of it
    pairs = counts.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    hot = common.where(F.col("docs") >= max(min_docs, -(-pairs // HOT_KEYS))).select(*KEY, F.lit(True).alias("_hot"))
    lines = hashed(rows.select("_row", F.posexplode(line_keys(F.col("_text"))).alias("_at", "_key")).where(long_enough), "_key")
    lines = lines.join(F.broadcast(hot), KEY, "left")
    # a hot line needs no partner any more: it travels under a key of its own, so no task gets them all
    lines = lines.withColumn(KEY[0], F.when(F.col("_hot"), F.xxhash64("_row", "_at")).otherwise(F.col(KEY[0])))
    found = (lines.join(common.select(*KEY, F.lit(True).alias("_common")), KEY, "left")
             .where(F.col("_hot") | F.col("_common")))
    places = found.groupBy("_row").agg(F.sort_array(F.collect_list("_at")).alias("_drop"))

    split = F.split(F.coalesce("_text", F.lit("")), "\n", -1)
    out = (rows.join(places, "_row", "left").withColumn("_lines", split)
           .withColumn("n_lines", F.size("_lines").cast("long"))
           .withColumn("n_dropped", F.coalesce(F.size("_drop"), F.lit(0)).cast("long")))
    # the stretches between dropped places: linear in the number of lines
    ends = F.concat(F.col("_drop"), F.array(F.col("n_lines").cast("int")))
    stretches = F.transform(ends, lambda end, i: F.slice(
        F.col("_lines"), F.when(i == 0, 1).otherwise(F.get(ends, i - 1) + 2),
        end - F.when(i == 0, 0).otherwise(F.get(ends, i - 1) + 1)))
    kept = F.when(F.col("_drop").isNull(), F.coalesce("_text", F.lit(""))).otherwise(F.array_join(F.flatten(stretches), "\n"))
    out = out.withColumn("kept_text", kept)
    return out.select("_doc.*" if carry else F.col("_doc").alias(doc_id), *RESULT)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    out = drop_common_lines(table(spark, sf_dir, "documents"), carry=False)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
