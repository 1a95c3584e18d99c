"""Helpers shared by the corpus operators: tables, shared storage, components."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kasaflow.session import ensure_checkpoint_dir, ship_package

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
COPIES = 1_000                # rows alike that may share one order key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; also makes the package importable on executors."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder under the shared checkpoint folder and read
    it back: cuts the lineage, survives lost executors, and fixes the rows."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """``base``, with underscores added until no column of ``df`` has that name
    (Spark resolves names without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def doc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (NULL id: -1)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(-1))


def with_batch(df: DataFrame, by: list[str], at: str, column: str) -> DataFrame:
    """``df`` plus a batch number for rows alike in ``by``: their copy number (from 0) divided by
    COPIES, which is 0 wherever at most COPIES rows are alike. So the batches, as a set, follow from
    the rows alone, and no key with the batch added has more than COPIES rows.

    ``at`` is a stored ``monotonically_increasing_id``. Copies are numbered per partition that wrote
    them and shifted by the counts of earlier ones; no task holds all copies of a row. Only keys with
    more than COPIES rows are numbered: the table of these has at most a COPIES-th of the rows, and
    Spark broadcasts it only where its files are small."""
    names = [f"_{i}_alike" for i in range(len(by))]
    keys = [F.col(c).alias(n) for c, n in zip(by, names)]
    many = written(df.groupBy(*keys).count().where(F.col("count") > COPIES).select(*names), "alike")
    same = F.lit(True)
    for c, n in zip(by, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    part = F.shiftright(at, 33)
    hot = df.join(many, same, "left_semi").withColumn("_part", part)
    before = Window.partitionBy(*names).orderBy("_writer").rowsBetween(Window.unboundedPreceding, -1)
    base = (hot.groupBy(*keys, F.col("_part").alias("_writer")).agg(F.count("*").alias("_m"))
            .select(*names, "_writer", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_base")))
    nth = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(at)) - 1
    hot = hot.withColumn("_nth", nth).join(base, same & (F.col("_part") == F.col("_writer")))
    batch = F.floor((F.col("_base") + F.col("_nth")) / COPIES).cast("long")
    rest = df.join(many, same, "left_anti").withColumn(column, F.lit(0).cast("long"))
    return rest.unionByName(hot.select(*df.columns, batch.alias(column)))


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows known to the driver, parsed from one literal on the JVM (no Python worker)."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def binary_search(values: list[int], key: Column) -> Column:
    """How many of the sorted ``values`` are <= ``key``; a fold over
    log2(len(values)) halvings of a constant array, all on the JVM."""
    if not values:
        return F.lit(0)
    arr = F.lit(values)
    state = "struct<lo:int,hi:int>"

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        go = (s["lo"] < s["hi"]) & (F.get(arr, mid) <= key)
        lo = F.when(go, mid + 1).otherwise(s["lo"])
        hi = F.when((s["lo"] < s["hi"]) & ~go, mid).otherwise(s["hi"])
        return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")).cast(state)

    steps = F.sequence(F.lit(0), F.lit(len(values).bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(values)).alias("hi")).cast(state)
    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node on an edge; component = smallest node.

    Alternating large-star and small-star rounds over the edge table. A round
    is two grouped minima (combined map-side) and two equi-joins, whose hot
    nodes AQE can split; nothing is gathered per component. Every round is
    checkpointed, so the lineage stays short. Self loops are ignored; an
    empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where("u <> v").distinct().checkpoint())
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
                 .select("p.*").where("u <> v").distinct())
        e = small.checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
