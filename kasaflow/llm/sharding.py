"""Sharding by sampled splitters (DataFrame functions only).

Keys are hashes of the text, so equal texts are neighbours. A size-weighted
sample of the keys gives quantile boundaries; records are range-partitioned by
them; ranges that turn out overfull are subdivided: a key that alone fills
much of a range gets sub-ranges of its own by a hash of the record id, and the
rest of the range is split by a second hash of the key. Exact byte totals of
the (bounded number of) sub-ranges then place the shard boundaries, so shard
sizes differ by little more than one record, whatever the sample was.

Defined cases: NULL text has size 1 (no bytes plus 1) and the key of NULL;
NULL ids sort first; repeated rows are separate records (their slots are
interchangeable), dealt in batches of COPIES where they are many, so that
sub-ranges split them like other rows; an empty table gives an empty result; other columns are
carried along, and the added columns replace same-named ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kasaflow.llm.common import binary_search, table, with_batch, written

SHARDS = 16
SAMPLES_PER_RANGE = 32        # expected sample rows a range: about 18 % deviation in its size
ROWS_PER_RANGE = 100_000      # aimed at; bounds what one window task sorts
MIN_RANGES, MAX_RANGES = 256, 16_384
OVERFULL = 2.0                # a range of more than this times the mean size or rows is subdivided
WHOLE_GROUP = 0.01            # a group of equal texts up to this part of a shard stays in one shard

RESULT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def shard_records(df: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id",
                  carry: bool = True) -> DataFrame:
    """``df`` (or, without ``carry``, only its id) plus the RESULT columns.

    Law ``bytes``: shard sizes near equal. The statistics passes read id, size
    and key from one written table; texts move at most once, and only with
    ``carry``, to meet their places by row number."""
    df = df.drop(*RESULT)
    keyed = written(df.select(
        F.monotonically_increasing_id().alias("_at"),  # written once, so every pass sees the same numbers
        *([F.struct(*df.columns).alias("_row")] if carry else []),  # packed: no clash with names used here
        F.col(doc_id).alias("_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(text)).alias("_key")), "shard-keyed")
    digest = with_batch(keyed.drop("_row"), ["_id", "_key"], "_at", "_batch")
    digest = digest.withColumn("_tie", F.xxhash64(F.col("_id").cast("string"), F.lit(1), "_batch")).drop("_batch")
    rows, total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(MIN_RANGES, min(MAX_RANGES, rows // ROWS_PER_RANGE))

    # Size-weighted sample: a record is drawn with probability size * rate (Poisson thinning by a
    # fixed hash, so reruns agree). The number of draws is bounded by 1.5 * ranges * SAMPLES_PER_RANGE
    # in expectation, and at most that many distinct keys come to the driver as splitters.
    rate = ranges * SAMPLES_PER_RANGE / max(total, 1)
    u = F.pmod(F.xxhash64("_tie", "_key", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    quantiles = [i / ranges for i in range(1, ranges)]
    row = (digest.where(u < F.col("size") * F.lit(rate))
           .agg(F.percentile_approx("_key", quantiles, 20 * ranges).alias("q")).first())
    splitters = sorted(set(row["q"] or []))

    placed = written(digest.withColumn("_range", binary_search(splitters, F.col("_key"))), "shard-placed")
    per_range = placed.groupBy("_range").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    mean_rows, mean_bytes = max(rows / ranges, 1.0), max(total / ranges, 1.0)
    over = (per_range.where((F.col("n") > OVERFULL * mean_rows) | (F.col("b") > OVERFULL * mean_bytes))
            .select("_range", F.ceil(F.greatest(F.col("n") / mean_rows, F.col("b") / mean_bytes)).cast("int").alias("_parts")))
    # Keys that fill more than a mean range by themselves: at most 2 * ranges of them.
    heavy = (placed.groupBy("_key").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
             .where((F.col("n") > mean_rows) | (F.col("b") > mean_bytes))
             .select("_key", F.ceil(F.greatest(F.col("n") / mean_rows, F.col("b") / mean_bytes)).cast("int").alias("_own")))
    over, heavy = written(over, "shard-over"), written(heavy, "shard-heavy")

    # _sub: 0.. for parts of a range, after them the parts of its heavy keys. Both tables have a
    # bounded number of rows (see above).
    parts = placed.join(F.broadcast(over), "_range", "left").join(F.broadcast(heavy), "_key", "left")
    parts = parts.withColumn("_sub", F.when(
        F.col("_own").isNotNull(),
        F.concat(F.lit("k"), F.col("_key").cast("string"), F.lit("-"), F.pmod(F.col("_tie"), F.col("_own")).cast("string")))
        .otherwise(F.concat(F.lit("a"), F.coalesce(F.pmod(F.xxhash64("_key"), F.col("_parts")), F.lit(0)).cast("string")))
    ).withColumn("_whole", F.col("_own").isNull()).drop("_own", "_parts")

    cell = ["_range", "_sub"]
    cells = parts.groupBy(*cell).agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    upto = Window.orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)  # one row a sub-range, bounded
    cells = written(cells.select(*cell, F.coalesce(F.sum("b").over(upto), F.lit(0)).alias("_b0"),
                                 F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_n0")), "shard-cells")

    # global position and shard of every record
    order = Window.partitionBy(*cell).orderBy("_key", "_tie", "_id", "size", "_at")
    group = Window.partitionBy(*cell, "_key")
    laid = parts.join(F.broadcast(cells), cell)
    laid = laid.withColumn("_end", F.col("_b0") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.withColumn("_pos", F.col("_n0") + F.row_number().over(order) - 1)
    laid = laid.withColumn("_g1", F.max("_end").over(group)).withColumn("_gb", F.sum("size").over(group))
    # middle of the record, or of its whole group where the group is small, doubled
    mid2 = F.when(F.col("_whole") & (F.col("_gb") <= WHOLE_GROUP * (total / shards)), 2 * F.col("_g1") - F.col("_gb")) \
        .otherwise(2 * F.col("_end") - F.col("size"))
    shard = F.floor(mid2.cast("double") / float(2 * max(total, 1)) * shards)
    laid = written(laid.select("_at", "_id", "size", "text_crc32", "_pos",
                               F.least(shard.cast("int"), F.lit(shards - 1)).alias("shard")), "shard-laid")

    starts = laid.groupBy("shard").agg(F.min("_pos").alias("_s0"))  # one row a shard
    out = (laid.join(F.broadcast(starts), "shard").withColumn("slot", F.col("_pos") - F.col("_s0"))
           .withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int")))
    if not carry:
        return out.select(F.col("_id").alias(doc_id), *RESULT)
    return keyed.select("_at", "_row").join(out.select("_at", *RESULT), "_at").select("_row.*", *RESULT)


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_records(table(spark, sf_dir, "documents"), carry=False)
