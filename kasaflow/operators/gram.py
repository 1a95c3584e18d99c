"""Per-group Gram matrices and least-squares solves.

A regression per series is split into
1. a distributed aggregate: G[i][j] = sum over rows of a_i * a_j for the row
   vector a = (y, x_1, ..., x_k). Each task turns its Arrow batches into one
   partial matrix per group (numpy X^T X); a ``groupBy(group, i)`` adds the
   partial rows, so the data pass is a two-phase aggregate with the partial
   phase before the shuffle. (A posexplode of every row into k + 1 rows with
   k + 1 sums each was measured ~10x slower.)
2. a small solve per group over its (k+1) x (k+1) matrix, in numpy through
   ``applyInPandas``. A group there is k+1 rows of k+1 numbers, whatever the
   number of data rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _partial_gram(keys: list[str], k: int):
    names = [f"_c{j}" for j in range(k)]

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            out = []
            for key, grp in pdf.groupby(keys, sort=False, dropna=False):
                X = grp[names].to_numpy(dtype=float)
                X = X[~np.isnan(X).any(axis=1)]
                G = X.T @ X
                key = key if isinstance(key, tuple) else (key,)
                out.extend((*key, i, G[i]) for i in range(k))
            yield pd.DataFrame(out, columns=keys + ["i", "g"])
    return run


def gram_rows(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(keys..., i, g) where g[j] = sum(cols[i] * cols[j]) over the group's rows.

    Two-phase aggregate: each task folds its Arrow batches into one partial
    matrix per group with numpy (X^T X, no per-row explosion), then a grouped
    sum over the partial rows finishes it. Rows of one group may sit in any
    number of tasks; rows with a NULL among ``cols`` take no part.
    """
    k = len(cols)
    sub = df.select(*keys, *[F.col(c).cast("double").alias(f"_c{j}") for j, c in enumerate(cols)])
    schema = T.StructType([sub.schema[name] for name in keys]
                          + [T.StructField("i", T.IntegerType()),
                             T.StructField("g", T.ArrayType(T.DoubleType()))])
    part = sub.mapInPandas(_partial_gram(keys, k), schema)
    sums = [F.sum(F.col("g")[j]).alias(f"g{j}") for j in range(k)]
    return (part.groupBy(*keys, "i").agg(*sums)
            .select(*keys, "i", F.array(*[f"g{j}" for j in range(k)]).alias("g")))


def matrix_from_rows(idx, arrays, size: int | None = None) -> np.ndarray:
    """Dense matrix from (row index, row array) pairs of one group."""
    rows = sorted(zip(list(idx), list(arrays)), key=lambda t: t[0])
    m = np.array([np.asarray(a, dtype=float) for _, a in rows])
    if size is not None:
        m = m[:size, :size]
    return m


def ols_from_gram(G: np.ndarray, y: int, xs: list[int]):
    """(beta, ssr, XtX) of y on columns xs, from the Gram matrix. None if singular."""
    XtX = G[np.ix_(xs, xs)]
    Xty = G[xs, y]
    try:
        beta = np.linalg.solve(XtX, Xty)
    except np.linalg.LinAlgError:
        return None
    ssr = float(G[y, y] - beta @ Xty)
    return beta, ssr, XtX
