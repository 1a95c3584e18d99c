"""Mixing sources to target weights (DataFrame functions only).

Every source's documents are put in a fixed shuffled order and laid end to
end; that line of words is cut into blocks of equal length. A golden-ratio
sequence gives the schedule: point i falls into a source's part of the
cumulative weights, and the slots of a source are ranked. The r-th slot of a
source takes its block r modulo the number of its blocks, so a source is read
again only after all of it has been read once. The last slot of a source is
cut where the source's target is reached, and sources that the schedule gave
too few slots get the missing ones at its end, so each source gives its target
to the word.

Hot sources: order and running totals are computed per (source, hash chunk),
and chunk totals are added up in a second, small step; no task holds a source.
Where more than COPIES rows are alike in id, source and size (rows without ids,
say), every further batch of COPIES of them has an order key, so a chunk, of its own.

The number of sources is the number of distinct values of the source column;
their totals come to the driver to work out the targets (one small row each).

Defined cases: NULL text or a text without words has size 0 and gives 0 words;
NULL source is a source of its own, last in order; repeated rows and rows
without ids are separate documents; an empty table gives an empty result; other columns are carried.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kasaflow.llm.common import WORD_PATTERN, binary_search, literal_rows, table, with_batch, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 4096
ROWS_PER_CHUNK = 20_000
ORDER_BITS = 60
SLOTS_PER_CHUNK = 65_536
GOLDEN = 2_654_435_769        # 2**32 / golden ratio, to the nearest odd number


def targets(sizes: dict, weights=WEIGHTS, repeats: int = MAX_REPEATS) -> dict:
    """Words wanted from each source: shares of all words by repeating weights
    in code point order (None last), no source above ``repeats`` times its
    size, the excess shared again by weight among the others."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, got, free = float(sum(sizes.values())), {}, list(order)
    while free:
        left, w = total - sum(got.values()), sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / w > repeats * sizes[s]]
        if not full:
            return got | {s: left * weight[s] / w for s in free}
        got |= {s: float(repeats * sizes[s]) for s in full}
        free = [s for s in free if s not in got]
    return got


def shuffle_key(doc_id: str, size: str, batch: str):
    """60 bits of the md5 of id and size (and of the batch of copies, from the second on): a fixed
    shuffle that any SQL engine can repeat."""
    text = F.concat_ws("-", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(size).cast("string"),
                       F.when(F.col(batch) > 0, F.col(batch).cast("string")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, ORDER_BITS // 4), 16, 10).cast("long")


def with_size(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_size", F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long"))


def plan_sources(sized: DataFrame, source: str, block: int) -> list[dict]:
    """One entry a source: size, target, words to take, blocks, slots and its part of the schedule."""
    sizes = {r[0]: r[1] for r in sized.groupBy(source).agg(F.sum("_size")).collect()}
    want = targets(sizes)
    plan, upto = [], 0
    for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8")))):
        take = min(int(math.floor(want[s] + 0.5)), MAX_REPEATS * sizes[s])
        blocks = -(-sizes[s] // block)
        rounds, rest = divmod(take, sizes[s]) if sizes[s] else (0, 0)
        slots = rounds * blocks + -(-rest // block)
        plan.append({"k": k, "source": s, "size": sizes[s], "target": want[s], "take": take, "blocks": blocks,
                     "slots": slots, "lo": upto, "hi": upto + slots})
        upto += slots
    return plan


def schedule(spark, plan: list[dict]) -> DataFrame:
    """(slot, k, rank): which source each slot takes from, and its rank there.

    Point i is i * GOLDEN mod 2**32, exact in long arithmetic (two 16-bit
    halves). Ranks are numbered per (chunk of slots, source) and shifted by
    the totals of earlier chunks. Sources short of slots get them at the end;
    surplus ranks are left out."""
    n = plan[-1]["hi"] if plan else 0
    if n == 0:
        return spark.range(0).select(F.col("id").alias("slot"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("rank"))
    i = F.col("id") % (1 << 32)
    hi, lo = F.shiftright(i, 16), i.bitwiseAND(F.lit(0xFFFF))
    point = (((hi * GOLDEN) % (1 << 16)) * (1 << 16) + lo * GOLDEN) % (1 << 32)
    edges = [math.ceil(p["lo"] * (1 << 32) / n) for p in plan]
    slots = (spark.range(n).withColumn("k", binary_search(edges, point) - 1)
             .withColumn("c", F.floor(F.col("id") / SLOTS_PER_CHUNK)))
    # several sources may share an edge (no slots); the search gives the last of them, which owns the point
    counts = slots.groupBy("c", "k").agg(F.count("*").alias("m"))
    before = Window.partitionBy("k").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("c", "k", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("c", "k").orderBy("id")
    ranked = (slots.withColumn("r", F.row_number().over(within) - 1).join(base, ["c", "k"])
              .select(F.col("id").alias("slot"), "k", (F.col("base") + F.col("r")).alias("rank")))
    info = literal_rows(spark, [{"k": p["k"], "slots": p["slots"]} for p in plan], "k int, slots long")
    got = counts.groupBy("k").agg(F.sum("m").alias("got"))
    missing = (info.join(got, "k", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("slots > got")
               .select("k", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("rank"))
               .select((F.lit(n) + F.col("rank")).alias("slot"), "k", "rank"))
    return ranked.join(F.broadcast(info), "k").where("rank < slots").drop("slots").unionByName(missing.select("slot", "k", "rank"))


ADDED = ["size", "source_size", "target", "taken"]


def mix(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", block: int = BLOCK_WORDS,
        carry: bool = True) -> DataFrame:
    """Columns of ``df`` (or only the id) plus size, source_size, target, taken."""
    df = df.drop(*ADDED)
    if not carry:
        return _mixed(df, None, text, source, doc_id, block).select(F.col("_id").alias(doc_id), *ADDED)
    return _mixed(df, df.columns, text, source, doc_id, block).select("_row.*", *ADDED)


def _mixed(df: DataFrame, kept: list[str] | None, text: str, source: str, doc_id: str, block: int) -> DataFrame:
    """_id and the ADDED columns; with ``kept``, _row (these columns as one) in place of _id."""
    spark = df.sparkSession
    packed = with_size(df.select(*([F.struct(*kept).alias("_row")] if kept else []), F.col(doc_id).alias("_id"),
                                 F.col(source).alias("_source"), F.col(text).alias("_text")), "_text").drop("_text")
    # written once with row numbers: every pass sees the same ones, and words are counted once
    packed = written(packed.withColumn("_at", F.monotonically_increasing_id()), "mix-packed")
    sized = with_batch(packed.drop("_row"), ["_id", "_source", "_size"], "_at", "_batch")
    sized = sized.withColumn("_order", shuffle_key("_id", "_size", "_batch")).drop("_batch")
    plan = plan_sources(packed, "_source", block)
    rows = packed.count()
    info = literal_rows(
        spark, [{"k": p["k"], "s": p["source"], "source_size": p["size"], "target": p["target"], "take": p["take"],
                 "blocks": p["blocks"]} for p in plan],
        "k int, s string, source_size long, target double, take long, blocks long")
    chunk_bits = max(6, (rows // ROWS_PER_CHUNK).bit_length())
    sized = (sized.join(F.broadcast(info), F.col("_source").eqNullSafe(F.col("s"))).drop("s")
             .withColumn("_chunk", F.shiftright("_order", ORDER_BITS - chunk_bits)))
    per = sized.groupBy("k", "_chunk").agg(F.sum("_size").alias("w"))
    before = Window.partitionBy("k").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("k", "_chunk", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("_base"))
    # Rows alike in id, source and size are interchangeable; many of them have an order key a batch.
    upto = Window.partitionBy("k", "_chunk").orderBy("_order", "_id", "_size", "_at").rowsBetween(Window.unboundedPreceding, 0)
    line = (sized.withColumn("_upto", F.sum("_size").over(upto)).join(base, ["k", "_chunk"])
            .withColumn("start", F.col("_base") + F.col("_upto") - F.col("_size"))
            .withColumn("end", F.col("_base") + F.col("_upto")))
    line = written(line.select("_id", "_at", "_size", "k", "start", "end", "blocks", "source_size", "target"), "mix-line")

    slots = schedule(spark, plan).join(F.broadcast(info.select("k", "take", "blocks", "source_size")), "k")
    turn, blk = F.floor(F.col("rank") / F.col("blocks")), F.col("rank") % F.col("blocks")
    used = slots.select("k", blk.alias("blk"), F.least(
        F.col("take") - turn * F.col("source_size"), (blk + 1) * block, F.col("source_size")).alias("stop"))
    parts = (line.where("_size > 0")
             .withColumn("blk", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
             .withColumn("from", F.greatest("start", F.col("blk") * block))
             .withColumn("to", F.least("end", (F.col("blk") + 1) * block)))
    words = F.greatest(F.lit(0), F.least("to", "stop") - F.col("from"))
    taken = (parts.join(used, ["k", "blk"]).groupBy("k", "start", "end")
             .agg(F.sum(words).cast("long").alias("taken")))  # start and end are unique where words are
    done = (line.join(taken, ["k", "start", "end"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
            .withColumnRenamed("_size", "size"))
    if not kept:
        return done.select("_id", *ADDED)
    return packed.select("_at", "_row").join(done.select("_at", *ADDED), "_at").select("_row", *ADDED)


def mixed_documents(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
                    block: int = BLOCK_WORDS) -> DataFrame:
    """The mix in whole documents: every row as many times as the schedule takes it (a row at a
    source's cut counts if half of it or more is taken; rows without words are not in a mix of words)."""
    mixed = _mixed(df, df.columns, text, source, doc_id, block)
    copies = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    return (mixed.withColumn("_n", copies).where("_n > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*"))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), carry=False)
