"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length (falling) and cut into buckets of bounded size; a
bucket keeps its vectors' norms and, per coordinate, their order. Queries come
in blocks of bounded size. First every query block meets the bucket of the
longest vectors, which gives each query a k-th best score so far; then it
meets the other buckets with that threshold. In a bucket the threshold becomes
a local cosine threshold: threshold / (query length * longest length). Above 1
the bucket is skipped. Where it is high, coordinate pruning keeps the vectors
whose entries in the query's heaviest coordinates lie in the feasible range;
where it is low, length pruning keeps the vectors long enough. The inner
products of what is left are then computed exactly in integers.

Query blocks are sent to the buckets by an equi-join on the bucket number (a
stated query set against all rows, in blocks); a bucket is one row of packed
arrays. Only candidates that reach the threshold are shuffled at the end.

Components x become floor(1024 * x), x as double. Scores are exact: products
run in doubles below 2**53, else in int64, else in Python's integers. Defined
cases: vectors that are NULL, or hold NULL or non-finite components (also
after scaling), take no part, nor do NULL ids; a pair whose score does not fit
a long is no result; shorter vectors count as padded with zeros; rows of a
repeated vec_id are all candidates and all queries, and the queries of one id
share its ranking (``one_per_id``: only the smallest vector of an id, arrays
compared in order, takes part); ties go to the smaller vec_id; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kasaflow.llm.common import table, written

K, EVERY = 10, 100
SCALE = 1024
BUCKET, QUERY_BLOCK = 4_096, 512
NONE = -(1 << 63)              # no threshold yet
LEVELS = 16
FOCUS = 4                     # coordinates looked at in coordinate pruning
COORDINATE_FROM = 0.35        # local cosine threshold from which coordinates prune better than lengths


def quantised(df: DataFrame, vec_id: str, vector: str, one_per_id: bool) -> DataFrame:
    """(vec_id, v) of the vectors that take part; v holds whole numbers as doubles (from 2**53 on every
    double is one; F.floor gives a long, which they need not fit)."""
    scaled = lambda c: c.cast("double") * SCALE
    x = F.transform(F.col(vector), lambda c: F.when(F.abs(scaled(c)) < 2.0 ** 53, F.floor(scaled(c)).cast("double")).otherwise(scaled(c)))
    fit = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(scaled(c)) < float("inf"))
    out = (df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).where(F.forall(vector, fit))
           .select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("v")))
    return out.groupBy("vec_id").agg(F.min("v").alias("v")) if one_per_id else out


def _bytes(m: np.ndarray) -> bytes:
    """int32 where all entries fit, else doubles; ``_entries`` tells them apart by their size."""
    return (m.astype(np.int32) if np.abs(m).max(initial=0) < 1 << 31 else m).tobytes()


def _entries(b: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(b, np.int32 if len(b) == 4 * rows * dim else np.float64).reshape(rows, dim).astype(np.float64)


def _lengths(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):  # infinite lengths prune nothing
        return np.sqrt((m * m).sum(1))


def _matrix(rows, dim: int) -> np.ndarray:
    m = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        m[i, :len(r)] = r
    return m


def _pack(dim: int, size: int):
    """Rows (already in their order) to blocks of up to ``size``: ids, matrix."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rows = [], []

        def block():
            m = _matrix(rows, dim)
            norm = _lengths(m)
            return pd.DataFrame({"ids": [np.array(ids, np.int64).tobytes()], "m": [_bytes(m)],
                                 "lo": [float(norm.min())], "hi": [float(norm.max())]})
        for pdf in batches:
            for i, v in zip(pdf["vec_id"], pdf["v"]):
                ids.append(i)
                rows.append(v)
                if len(ids) == size:
                    yield block()
                    ids, rows = [], []
        if ids:
            yield block()
    return pack


PACKED = "ids binary, m binary, lo double, hi double"


class Bucket:
    """The vectors of one bucket, longest first, with the order of each coordinate's entries."""

    def __init__(self, ids: bytes, m: bytes, dim: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.m = _entries(m, len(self.ids), dim)
        self.norm = _lengths(self.m)
        self.largest = float(np.abs(self.m).max(initial=0))
        order = np.argsort(-self.norm, kind="stable")
        self.ids, self.m, self.norm = self.ids[order], self.m[order], self.norm[order]
        self.unit = self.m / np.maximum(self.norm, 1e-300)[:, None]
        self.by_coordinate: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def entries(self, c: int):
        if c not in self.by_coordinate:
            order = np.argsort(self.unit[:, c], kind="stable")
            self.by_coordinate[c] = (self.unit[order, c], order)
        return self.by_coordinate[c]

    def candidates(self, q: np.ndarray, q_norm: float, threshold: float) -> np.ndarray:
        """Rows that may reach ``threshold`` with q (a superset, exact up to a safe margin)."""
        n = len(self.ids)
        if threshold == -np.inf:
            return np.arange(n)
        if q_norm == 0:
            return np.arange(n if threshold <= 0 else 0)
        if threshold > 0:  # length pruning: the product is at most the product of the lengths
            n = int(np.searchsorted(-self.norm, -(threshold / q_norm) * (1 - 1e-9), "right"))
        if n == 0:
            return np.arange(0)
        local = threshold / (q_norm * self.norm[0]) if self.norm[0] > 0 else -np.inf
        if local < COORDINATE_FROM:
            return np.arange(n)
        # coordinate pruning: cos >= local leaves only a range for each coordinate
        t, u = min(local, 1.0) * (1 - 1e-9), q / q_norm
        focus = np.argsort(-np.abs(u), kind="stable")[:FOCUS]
        spread = np.sqrt((1 - t * t) * np.maximum(0, 1 - u[focus] ** 2)) + 1e-9
        low, high = t * u[focus] - spread, t * u[focus] + spread
        # from cos(angle to the axis): entries beyond the bound on the near side are feasible only up to 1
        low = np.where(u[focus] <= -t, -1.0, low)
        high = np.where(u[focus] >= t, 1.0, high)
        cuts = []
        for c, a, b in zip(focus, low, high):
            values, order = self.entries(int(c))
            i, j = np.searchsorted(values, a, "left"), np.searchsorted(values, b, "right")
            cuts.append((j - i, int(c), i, j, order, a, b))
        _, c0, i, j, order, _, _ = min(cuts, key=lambda x: x[0])
        rows = order[i:j]
        rows = rows[rows < n]
        for _, c, _, _, _, a, b in cuts:
            if c != c0:
                v = self.unit[rows, c]
                rows = rows[(v >= a) & (v <= b)]
        return rows


def _scores(m: np.ndarray, q: np.ndarray, largest: float) -> tuple[np.ndarray, np.ndarray]:
    """Exact products of the rows (entries up to ``largest``) with q, and which of them fit a long."""
    with np.errstate(over="ignore", invalid="ignore"):
        # whole numbers below 2**53 / dim: exact in doubles, whatever the order of the sum
        if len(q) * float(np.abs(q).max(initial=0)) * largest < 2.0 ** 53:
            return (m @ q).astype(np.int64), np.ones(len(m), bool)
        bound = np.abs(m) @ np.abs(q)
        score, fits = (m.astype(np.int64) * q.astype(np.int64)).sum(1), np.ones(len(m), bool)
        for i in np.flatnonzero(~(bound < 2.0 ** 62)):
            exact = sum(int(x) * int(y) for x, y in zip(m[i].tolist(), q.tolist()))
            fits[i] = -1 << 63 <= exact < 1 << 63
            score[i] = exact if fits[i] else 0
    return score, fits


def _search(dim: int, k: int):
    """A (query block, bucket) row to the best k of the bucket for each query that reach its threshold."""
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, bucket = None, None
        for pdf in batches:
            for b, ids, m, q_ids, q_m, floor_ in zip(pdf["bucket"], pdf["ids"], pdf["m"], pdf["q_ids"], pdf["q_m"], pdf["floor"]):
                if b != last:
                    last, bucket = b, Bucket(ids, m, dim)
                q_id = np.frombuffer(q_ids, np.int64)
                q = _entries(q_m, len(q_id), dim)
                least = np.frombuffer(floor_, np.int64) if floor_ is not None else np.full(len(q_id), NONE, np.int64)
                threshold = np.where(least == NONE, -np.inf, least.astype(np.float64))
                norms = _lengths(q)
                got = [], [], []
                for i in range(len(q_id)):
                    rows = bucket.candidates(q[i], norms[i], threshold[i])
                    rows = rows[bucket.ids[rows] != q_id[i]]
                    score, fits = _scores(bucket.m[rows], q[i], bucket.largest)
                    on = fits & (score >= least[i])
                    rows, score = rows[on], score[on]
                    order = np.lexsort((bucket.ids[rows], ~score))[:k]  # ~: falling, without overflow
                    got[0].append(np.full(len(order), q_id[i]))
                    got[1].append(bucket.ids[rows[order]])
                    got[2].append(score[order])
                yield pd.DataFrame({"query_id": np.concatenate(got[0]), "vec_id": np.concatenate(got[1]),
                                    "score": np.concatenate(got[2])})
    return search


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K,
          one_per_id: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best for every id with ``is_query`` (an expression on vec_id)."""
    spark = vectors.sparkSession
    clean = written(quantised(vectors, vec_id, vector, one_per_id), "topk-vectors")
    rows, dim = clean.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_buckets, norm2 = max(1, -(-rows // BUCKET)), F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    # longest first; ties (a common vector) are dealt on by id, so no bucket grows with them
    buckets = (clean.withColumn("n2", norm2).repartitionByRange(n_buckets, F.desc("n2"), F.asc("vec_id"))
               .sortWithinPartitions(F.desc("n2"), F.asc("vec_id")).select("vec_id", "v")
               .mapInPandas(_pack(dim, BUCKET), PACKED))
    buckets = written(buckets.withColumn("key", F.monotonically_increasing_id()), "topk-buckets")
    # Buckets numbered from the longest on: a window over one small row a bucket. Of the numbers only the
    # last of each length level (LEVELS to a doubling) goes to the driver, so what it gets is bounded.
    number = (F.row_number().over(Window.orderBy(F.desc("hi"), "key")) - 1).alias("bucket")
    numbered = written(buckets.select("key", "hi").select("key", "hi", number), "topk-numbers")
    level = F.floor(F.log2(F.greatest("hi", F.lit(0.5))) * LEVELS)
    levels = numbered.groupBy(level.alias("level")).agg(F.max("hi").alias("hi"), F.max("bucket").alias("last")).collect()
    buckets = buckets.drop("hi").join(numbered.select("key", "bucket"), "key")
    queries = (clean.where(is_query).repartition(max(1, rows // (EVERY * QUERY_BLOCK)), "vec_id").sortWithinPartitions("vec_id")
               .mapInPandas(_pack(dim, QUERY_BLOCK), PACKED)
               .select(F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), F.col("hi").alias("q_hi")))
    queries = written(queries.withColumn("block", F.monotonically_increasing_id()), "topk-queries")
    found = "query_id long, vec_id long, score long"
    if not levels:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def meet(q: DataFrame, b: DataFrame) -> DataFrame:
        pairs = q.join(b.select("bucket", "ids", "m"), "bucket").sortWithinPartitions("bucket")
        return pairs.select("bucket", "ids", "m", "q_ids", "q_m", "floor").mapInPandas(_search(dim, k), found)

    no_floor = F.lit(None).cast("binary")
    first = written(meet(queries.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(0)))).withColumn("floor", no_floor),
                         buckets.where("bucket = 0")), "topk-first")
    # k-th best so far of each query, packed in the order of its block
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    least = first.withColumn("nth", nth).where(F.col("nth") == k).select("query_id", F.col("score").alias("least"))

    def floors(pdf: pd.DataFrame) -> pd.DataFrame:
        q = np.frombuffer(pdf["q_ids"].dropna().iloc[0], np.int64)
        known = pdf[pdf["q_ids"].isna()]
        known = dict(zip(known["query_id"].tolist(), known["least"].tolist()))
        f = np.array([known.get(i, NONE) for i in q.tolist()], np.int64)
        lowest = float(f.min()) if f.min() > NONE else -np.inf
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "floor": [f.tobytes()], "lowest": [lowest]})

    # each query's block: its ids unpacked once
    def unpack(batches):
        for pdf in batches:
            for b, ids in zip(pdf["block"], pdf["q_ids"]):
                q = np.frombuffer(ids, np.int64)
                yield pd.DataFrame({"query_id": q, "block": b})
    of_block = queries.select("block", "q_ids").mapInPandas(unpack, "query_id long, block long").distinct()
    member = of_block.join(least, "query_id").select("block", "query_id", "least", F.lit(None).cast("binary").alias("q_ids"))
    # no NULL longs: pandas would read them as doubles and round ids and scores
    packed = member.unionByName(queries.select("block", F.lit(0).cast("long").alias("query_id"),
                                               F.lit(0).cast("long").alias("least"), "q_ids"))
    floor_of = packed.groupBy("block").applyInPandas(floors, "block long, floor binary, lowest double")
    armed = queries.join(floor_of, "block")
    # A block meets the buckets up to the last one whose length bound reaches its lowest threshold.
    reach = F.lit(0)
    for r in levels:
        near = (F.col("lowest") <= 0) | (F.lit(r["hi"]) * F.col("q_hi") * (1 + 1e-9) >= F.col("lowest"))
        reach = F.greatest(reach, F.when(near, F.lit(r["last"])).otherwise(0))
    pairs = armed.withColumn("last", reach).where("last > 0").withColumn("bucket", F.explode(F.sequence(F.lit(1), F.col("last"))))
    first = first.unionByName(meet(pairs, buckets.where("bucket > 0")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (first.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, F.col("vec_id") % EVERY == 0)
