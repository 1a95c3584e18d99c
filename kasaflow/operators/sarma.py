"""Seasonal ARMA models with their product structure, fitted to all series.

Two estimators of (p, d, q)(P, D, Q, s), both over DataFrames of series:

* ``product_fit``: least squares on the factors. The lag regression's Gram
  rows (one distributed pass, ``operators/gram.py``) hold all that Gauss-Newton
  needs, so a series is fitted from one (k + 1) x (k + 1) matrix. The factors
  stay stationary and invertible.
* ``exact_fit``: exact Gaussian likelihood (``functions/arma.py``). Spark
  collects every series into one row (its days: bounded by the calendar) and
  deals the rows over the tasks; a task filters the series of an Arrow batch,
  and all trial coefficients of a step, together. The factors of
  ``product_fit`` are its starting point where they are given.

NULLs are values not seen: the filter passes over them, and differences that
touch them are not seen either. A series of zeros or with too few values gets
NULL results. Coefficients are reported, and forecast with, to four decimals,
far below their standard errors, so reruns and other partitionings agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kasaflow.functions import arma
from kasaflow.functions.arma import Orders
from kasaflow.operators.diagnostics import eliminated
from kasaflow.operators.gram import matrix_from_rows, ols_from_gram
from kasaflow.operators.lagreg import (AR_LAGS, DIFFERENCED, MA_LAGS, MAX_ARMA, MAX_SEASONAL, MAX_SUM, SEARCH_LAGS, SEASON,
                                       _gram_with_count, differencer, search_gram, stage1_fit, stage2_columns)
from kasaflow.operators.series import KEYS, by_series, running, train_series

SEASONAL = Orders(0, 1, 0, 0, 1, 1, 7)     # on the levels
FULL = Orders(2, 0, 2, 2, 0, 1, 7)         # on the differences
SERIES_AT_ONCE = 32


# ---- least squares on the factors ------------------------------------------------------------------

def _lag_coefficients(orders: Orders, coefs: np.ndarray, ar_lags: list[int], ma_lags: list[int]) -> np.ndarray:
    """The multiplied factors' coefficients of the given lags."""
    out = []
    for poly, lags in zip(arma.expand(orders, coefs), (ar_lags, ma_lags)):
        full = np.zeros((len(poly), max(lags)))
        full[:, :poly.shape[1]] = poly
        out.append(full[:, np.array(lags) - 1])
    return np.hstack(out)


def gauss_newton(G: np.ndarray, x: np.ndarray, orders: Orders = FULL, ar_lags: list[int] = AR_LAGS, ma_lags: list[int] = MA_LAGS,
                 rounds: int = 100, h: float = 1e-6) -> tuple[np.ndarray, float]:
    """Partial autocorrelations of the factors of least residual sum, and that sum, from the Gram matrix of
    (y, lags of y, lags of e): damped Gauss-Newton steps inside the box."""
    k, m = orders.n, 1 + len(ar_lags) + len(ma_lags)
    A, g, total = G[1:m, 1:m], G[1:m, 0], float(G[0, 0])
    if k == 0:
        return x, total

    def betas(points: np.ndarray) -> np.ndarray:
        return _lag_coefficients(orders, arma.coefficients(orders, points), ar_lags, ma_lags)

    def ssr(b: np.ndarray) -> float:
        return float(total - 2 * b @ g + b @ A @ b)

    best, damp = ssr(betas(x[None])[0]), 1e-3
    for _ in range(rounds):
        both = betas(np.vstack([x + h * np.eye(k), x - h * np.eye(k), x[None]]))
        J = ((both[:k] - both[k:2 * k]) / (2 * h)).T
        down = J.T @ (g - A @ both[-1])
        square = J.T @ A @ J
        moved = False
        for _ in range(12):
            step = np.linalg.lstsq(square + damp * np.diag(np.maximum(np.diag(square), 1e-12)), down, rcond=None)[0]
            new = np.clip(x + step, -arma.BOUND, arma.BOUND)
            value = ssr(betas(new[None])[0])
            if value < best:
                gain, x, best, moved, damp = best - value, new, value, True, damp / 5
                break
            damp *= 4
        if not moved or gain <= 1e-12 * max(best, 1e-300):
            break
    return x, best


def _product_one(pdf: pd.DataFrame) -> pd.DataFrame:
    G = matrix_from_rows(pdf["i"], pdf["g"])
    out = {k: pdf[k].iloc[0] for k in KEYS} | {"coef": None, "ssr": np.nan, "free_ssr": np.nan, "nobs": float(G[-1, -1])}
    free = ols_from_gram(G, 0, list(range(1, 14)))
    if G[0, 0] > 0 and free is not None and np.isfinite(free[0]).all():
        b = free[0]     # the free coefficients of lags 1, 2, 7, 14 are the factors' own
        at = {name: i for i, name in enumerate(stage2_columns())}
        own = np.array([[b[at[c]] for c in ("x1", "x2", "x7", "x14", "e1", "e2", "e7")]])
        fits = [gauss_newton(G, np.clip(x, -0.9, 0.9)) for x in (arma.partials(FULL, own)[0], np.zeros(FULL.n), np.full(FULL.n, 0.3))]
        x, ssr = min(fits, key=lambda f: f[1])
        out |= {"coef": arma.coefficients(FULL, x[None])[0].tolist(), "ssr": ssr, "free_ssr": float(free[1])}
    return pd.DataFrame([out])


def product_fit(rows: DataFrame) -> DataFrame:
    """(KEYS, coef, ssr, free_ssr, nobs) from the rows of ``lagreg.stage_rows``: the factors of the (2,0,2)(2,0,1,7)
    model in the order of ``FULL.names()``, their residual sum, and that of 13 free lag coefficients."""
    gram = _gram_with_count(rows.filter(F.col(f"e{max(MA_LAGS)}").isNotNull()), "x", stage2_columns())
    return gram.groupBy(*KEYS).applyInPandas(
        _product_one, "nazwa_kasy string, measure string, coef array<double>, ssr double, free_ssr double, nobs double")


def factor_table(fit: DataFrame) -> DataFrame:
    """One row a factor coefficient: (KEYS, name, coef, ssr, free_ssr, nobs)."""
    names = F.array(*map(F.lit, FULL.names()))
    return fit.select(*KEYS, F.explode(F.arrays_zip(names.alias("name"), F.col("coef"))).alias("c"), "ssr", "free_ssr", "nobs") \
        .select(*KEYS, F.col("c.name").alias("name"), F.col("c.coef").alias("coef"), "ssr", "free_ssr", "nobs")


# ---- exact likelihood ------------------------------------------------------------------------------

FIT_SCHEMA = ("nazwa_kasy string, measure string, coef array<double>, se array<double>, sigma2 double, llf double, "
              "aic double, nobs long, settled boolean, pred array<double>")


def series_rows(train: DataFrame, x: str, horizon: DataFrame | None = None) -> DataFrame:
    """One row a series: its values in order (NULLs kept), as an array bounded by the calendar."""
    pairs = F.sort_array(F.collect_list(F.struct("rn", F.col(x).alias("x"))))
    out = train.groupBy(*KEYS).agg(F.transform(pairs, lambda p: p["x"].cast("double")).alias("y"))
    return out if horizon is None else out.join(horizon, KEYS)


def _exact(orders: Orders):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            series = [np.array([np.nan if v is None else v for v in y], float) for y in pdf["y"]]
            length = np.array([len(y) for y in series])
            for n in np.unique(length):
                members = np.flatnonzero(length == n)
                for lo in range(0, len(members), SERIES_AT_ONCE):
                    m = members[lo:lo + SERIES_AT_ONCE]
                    part = pdf.iloc[m]
                    y = np.array([series[i] for i in m])
                    yield _exact_batch(y, part, orders)
    return run


def _exact_batch(y: np.ndarray, part: pd.DataFrame, orders: Orders) -> pd.DataFrame:
    out = {k: part[k].to_numpy(object) for k in KEYS}
    n, steps = len(y), int(part["horizon"].max())
    if y.shape[1] <= orders.lost + orders.n + 2:
        return pd.DataFrame(out | {c: [None] * n for c in ("coef", "se")} | {c: [np.nan] * n for c in ("sigma2", "llf", "aic")}
                            | {"nobs": 0, "settled": False, "pred": [None] * n})
    start = None
    if "start" in part.columns:
        start = np.array([np.full(orders.n, np.nan) if s is None else np.asarray(s, float) for s in part["start"]])
    got = arma.fit(y, orders, start)
    pred = arma.forecast(y, orders, got["coef"], steps)
    live = np.isfinite(got["llf"])
    pred = [[None if not np.isfinite(v) else float(v) for v in row[:h]] if ok else None
            for row, h, ok in zip(pred, part["horizon"], live)]
    lists = {c: [[None if not np.isfinite(v) else float(v) for v in row] if ok else None for row, ok in zip(got[c], live)]
             for c in ("coef", "se")}
    return pd.DataFrame(out | lists | {c: got[c] for c in ("sigma2", "llf", "aic", "nobs", "settled")} | {"pred": pred})


def exact_fit(split: DataFrame, orders: Orders, x: str, starts: DataFrame | None = None) -> DataFrame:
    """(KEYS, coef, se, sigma2, llf, aic, nobs, settled, pred) of every series of a split table. ``pred``
    holds the forecast of ``x`` for the test days; ``starts`` has (KEYS, coef) to begin with."""
    horizon = split.groupBy(*KEYS).agg(F.max("n_test").alias("horizon"))
    rows = series_rows(train_series(split), x, horizon)
    if starts is not None:
        rows = rows.join(starts.select(*KEYS, F.col("coef").alias("start")), KEYS, "left")
    tasks = int(split.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *KEYS).mapInPandas(_exact(orders), FIT_SCHEMA)


def exact_summary(fit: DataFrame, orders: Orders) -> DataFrame:
    """One row a coefficient: estimate, standard error, z, and the fit's own figures."""
    names = F.array(*map(F.lit, orders.names()))
    out = fit.select(*KEYS, F.explode(F.arrays_zip(names.alias("name"), "coef", "se")).alias("c"), "sigma2", "llf", "aic", "nobs")
    return out.select(*KEYS, F.col("c.name").alias("name"), F.col("c.coef").alias("coef"), F.col("c.se").alias("se"),
                      F.try_divide("c.coef", "c.se").alias("z"), "sigma2", "llf", "aic", "nobs")


def exact_forecast(split: DataFrame, fit: DataFrame, x: str) -> DataFrame:
    """Forecast of the test days from a (written) fit: (KEYS, Data, h, value, diff, y_T, pred_diff, pred_level).

    A forecast of differences is summed up from the last training level; one of levels is differenced."""
    pred = fit.select(*KEYS, F.posexplode("pred").alias("at", "p")).withColumn("h", (F.col("at") + 1).cast("long")).drop("at")
    test = split.filter(F.col("split") == "test").withColumn("h", F.col("rn") - (F.col("n") - F.col("n_test")))
    start = split.filter(F.col("rn") == F.col("n") - F.col("n_test")).select(*KEYS, F.col("value").alias("y_T"))
    out = test.join(pred, KEYS + ["h"], "left").join(start, KEYS, "left")
    if x == "diff":
        out = out.withColumn("pred_diff", F.col("p")).withColumn("pred_level", F.col("y_T") + F.sum("p").over(running()))
    else:
        before = F.coalesce(F.lag("p").over(by_series()), F.col("y_T"))
        out = out.withColumn("pred_diff", F.col("p") - before).withColumn("pred_level", F.col("p"))
    return out.select(*KEYS, "Data", "h", "value", "diff", "y_T", "pred_diff", "pred_level")


# ---- order search with refit -------------------------------------------------------------------------

# --- fixed values: published smooth curve of the 5 % point of the seasonal unit-root regression, by season length
ROOT_CURVE = (-0.2937411, -0.2850853, -0.05983644, 0.7656451, -1.652202)
ROOT_LAGS = 3
FIRST_TRIES = [(2, 2, 1, 1), (0, 0, 0, 0), (1, 0, 0, 0), (0, 1, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1)]


def root_point(s: int = SEASON) -> float:
    a, b, c, mid, base = ROOT_CURVE
    x = np.log(s) - mid
    return float(a * np.exp(b * x + c * x * x) + base)


def seasonal_root(x: np.ndarray, s: int = SEASON) -> float:
    """t statistic of the seasonal lag in the regression of w = (1 - B)(1 - B^s) x on its own lags, on (1 - B^s) x one
    day before and on (1 - B) x one season before. Far below 0: no seasonal unit root. NaN: too few values."""
    d1, ds = x[1:] - x[:-1], x[s:] - x[:-s]
    w = ds[1:] - ds[:-1]                                      # w[i] is day s + 1 + i
    i = np.arange(ROOT_LAGS, len(w))
    if len(i) < 3 * s:
        return float("nan")
    X = np.column_stack([*[w[i - k] for k in range(1, ROOT_LAGS + 1)], ds[i], d1[i], w[i]])
    X = X[~np.isnan(X).any(axis=1)]
    steps = list(eliminated(X.T @ X, ROOT_LAGS + 1))
    dof = len(X) - ROOT_LAGS - 2
    if len(steps) <= ROOT_LAGS + 1 or dof <= 0:
        return float("nan")
    (sxx, sxy), (_, syy) = steps[-1][-2:, -2:]
    ssr = syy - sxy * sxy / sxx if sxx > 0 else 0.0
    return float(sxy / sxx / np.sqrt(ssr / dof / sxx)) if sxx > 0 and ssr > 0 else float("nan")


def has_seasonal_root(x: np.ndarray) -> bool:
    return seasonal_root(x) > root_point()


def neighbours(order: tuple[int, int, int, int]) -> list[tuple[int, int, int, int]]:
    """Orders one step away: p, q, P or Q by one, or p and q, or P and Q, together."""
    p, q, P, Q = order
    moves = [(a, b, c, d) for step in (1, -1) for a, b, c, d in
             ((step, 0, 0, 0), (0, step, 0, 0), (step, step, 0, 0), (0, 0, step, 0), (0, 0, 0, step), (0, 0, step, step))]
    found = [(p + a, q + b, P + c, Q + d) for a, b, c, d in moves]
    return [o for o in found if min(o) >= 0 and max(o[:2]) <= MAX_ARMA and max(o[2:]) <= MAX_SEASONAL and sum(o) <= MAX_SUM]


def stepwise(G: np.ndarray, n: float, keep: int = 3) -> tuple[list[tuple[tuple[int, int, int, int], np.ndarray]], int]:
    """The ``keep`` best (order, coefficients) and how many were tried: from the best of some first tries on to
    better neighbours, each fitted anew on its factors, by AIC; ends where no neighbour is better."""
    tried: dict[tuple, tuple[float, np.ndarray]] = {}

    def score(order: tuple) -> float:
        if order not in tried:
            p, q, P, Q = order
            o = Orders(p, 0, q, P, 0, Q, SEASON)
            starts = [np.zeros(o.n)] + ([np.full(o.n, 0.3)] if o.n else [])
            x, ssr = min((gauss_newton(G, s, o, SEARCH_LAGS, SEARCH_LAGS) for s in starts), key=lambda f: f[1])
            aic = n * np.log(max(ssr, 1e-300) / n) + 2.0 * o.n
            tried[order] = aic, arma.coefficients(o, x[None])[0]
        return tried[order][0]

    best = min(FIRST_TRIES, key=score)
    while True:
        near = min(neighbours(best), key=score)
        if score(near) >= score(best) - 1e-9:
            break
        best = near
    return [(o, tried[o][1]) for o in sorted(tried, key=lambda o: (tried[o][0], o))[:keep]], len(tried)


def _stepwise_one(pdf: pd.DataFrame) -> pd.DataFrame:
    G = matrix_from_rows(pdf["i"], pdf["g"])
    found, tried = [], 0
    if G[0, 0] > 0 and G[-1, -1] > 2 * MAX_SUM:
        found, tried = stepwise(G, float(G[-1, -1]))
    return pd.DataFrame([{k: pdf[k].iloc[0] for k in KEYS} | dict(zip(("p", "q", "sp", "sq"), order))
                         | {"start": coefs.tolist(), "n_tried": tried} for order, coefs in found],
                        columns=[*KEYS, "p", "q", "sp", "sq", "start", "n_tried"])


SEARCH_SCHEMA = ("nazwa_kasy string, measure string, p int, d int, q int, sp int, sd int, sq int, s int, n_tried int, "
                 "names array<string>, coef array<double>, sigma2 double, llf double, aic double, nobs long, settled boolean")


def _refit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exact likelihood of the chosen order of each series; series of one order and length together."""
    for pdf in batches:
        pdf = pdf.assign(length=pdf["y"].map(len))
        for (p, q, P, Q, _), part in pdf.groupby(["p", "q", "sp", "sq", "length"], sort=True):
            orders = Orders(int(p), 0, int(q), int(P), 0, int(Q), SEASON)
            y = np.array([[np.nan if v is None else v for v in row] for row in part["y"]], float)
            got = arma.fit(y, orders, np.array([np.asarray(c, float) for c in part["start"]]).reshape(len(part), orders.n))
            out = part[[*KEYS, "p", "d", "q", "sp", "sd", "sq", "n_tried"]].assign(s=SEASON)
            out["names"] = [orders.names()] * len(part)
            out["coef"] = [c.tolist() for c in got["coef"]]
            for c in ("sigma2", "llf", "aic", "nobs", "settled"):
                out[c] = got[c]
            yield out[[f.split()[0] for f in SEARCH_SCHEMA.split(", ")]]


def order_search_refit(split: DataFrame, x: str = "diff", write=lambda df, name: df) -> DataFrame:
    """Differencing by the seasonal unit-root regression and KPSS, then orders by a stepwise search that fits every
    candidate anew; of its three best, the one of the lowest exact AIC; one row a series. Series without a Gram
    matrix to search (too short, constant) have none."""
    start = train_series(split).select(*KEYS, "Data", "rn", F.col(x).alias("x"))
    z = write(start.groupBy(*KEYS).applyInPandas(differencer(has_seasonal_root), DIFFERENCED), "refit-series")
    gram = search_gram(z, write(stage1_fit(z, "x"), "refit-coef"))
    orders = gram.groupBy(*KEYS).applyInPandas(
        _stepwise_one, "nazwa_kasy string, measure string, p int, q int, sp int, sq int, start array<double>, n_tried int")
    orders = write(orders, "refit-orders")
    taken = z.groupBy(*KEYS).agg(F.max("d").alias("d"), F.max("sd").alias("sd"))
    rows = series_rows(z, "x").join(orders, KEYS).join(taken, KEYS)
    tasks = int(split.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fits = rows.repartition(tasks, *KEYS, "p", "q", "sp", "sq").mapInPandas(_refit, SEARCH_SCHEMA)
    names = [c for c in fits.columns if c not in KEYS]
    lowest = F.min(F.struct("aic", "p", "q", "sp", "sq", F.struct(*names).alias("fit"))).alias("best")
    return fits.where("aic = aic").groupBy(*KEYS).agg(lowest).select(*KEYS, "best.fit.*")
