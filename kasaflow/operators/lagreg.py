"""Seasonal ARMA (2,0,2)(2,0,1,7) by two-stage least squares, and an order
search over its sub-models; all series at once.

Hannan-Rissanen:
1. a long autoregression AR(``LONG_AR``) of x (no constant) estimates the
   innovations e_hat = x - sum a_k x_{t-k};
2. x_t is regressed on the lags of x and e_hat that the multiplicative model
   (1 - p1 B - p2 B^2)(1 - P1 B^7 - P2 B^14) x = (1 + q1 B + q2 B^2)(1 + Q1 B^7) e
   touches: x lags 1, 2, 7, 8, 9, 14, 15, 16 and e lags 1, 2, 7, 8, 9. The
   coefficients are left unconstrained (not the products of the polynomial
   factors): the same model family estimated by least squares, not the
   exact-likelihood fit, so coefficients differ from a state-space solver.

Data passes are Spark windows and grouped Gram sums; the solves get one
(k + 1) x (k + 1) matrix per series. The multi-step forecast runs per series
over its last 16 rows and the horizon only.

The order search picks the differencing first and the orders then. D (0 or 1)
by the strength of the weekly pattern, d (0, 1 or 2) by the KPSS level test,
one differencing at a time. Every (p, q, P, Q) with p, q <= 5, P, Q <= 2 and
p + q + P + Q <= 5 (the usual limits of automatic searches) is then scored by
AIC = n log(SSR / n) + 2 k on one stage-2 Gram matrix of the differenced
series: the candidates are column subsets of the full design, so no further
data pass is needed, and the chosen candidate's coefficients are returned.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kasaflow.operators.gram import gram_rows, matrix_from_rows, ols_from_gram
from kasaflow.operators.series import KEYS, lags_sql

LONG_AR = 28
SEASON = 7
AR_LAGS = [1, 2, 7, 8, 9, 14, 15, 16]
MA_LAGS = [1, 2, 7, 8, 9]


def _solve_rows(names: list[str]):
    """applyInPandas body: Gram rows of one series -> (KEYS, coef array, ssr, nobs).

    The Gram matrix carries a trailing column of ones, so G[-1, -1] is the
    number of rows (no separate count and join)."""
    k = len(names)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        G = matrix_from_rows(pdf["i"], pdf["g"])
        n = float(G[k + 1, k + 1])
        fit = ols_from_gram(G, 0, list(range(1, k + 1)))
        coef = list(map(float, fit[0])) if fit is not None else None
        ssr = fit[1] if fit is not None else np.nan
        return pd.DataFrame([{"nazwa_kasy": pdf["nazwa_kasy"].iloc[0], "measure": pdf["measure"].iloc[0],
                              "coef": coef, "ssr": float(ssr), "nobs": n}])
    return solve


COEF_SCHEMA = "nazwa_kasy string, measure string, coef array<double>, ssr double, nobs double"


def _gram_with_count(rows: DataFrame, y: str, xs: list[str]) -> DataFrame:
    with_one = rows.select(*KEYS, y, *xs, F.lit(1.0).alias("_one"))
    return gram_rows(with_one, KEYS, [y] + xs + ["_one"])


def _regress(rows: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Per-series OLS of y on xs (no constant) through the Gram aggregate."""
    return _gram_with_count(rows, y, xs).groupBy(*KEYS).applyInPandas(_solve_rows(xs), COEF_SCHEMA)


def _dot(coef: str, cols: list[str]) -> str:
    """sum_k coef[k] * cols[k] as SQL arithmetic (stays in codegen)."""
    return " + ".join(f"{coef}[{i}] * {c}" for i, c in enumerate(cols))


def _lagged(train: DataFrame, x: str) -> DataFrame:
    base = train.select(*KEYS, "Data", "rn", F.col(x).alias("x"))
    return base.selectExpr("*", *lags_sql("x", range(1, LONG_AR + 1), "x"))


AR_COLUMNS = [f"x{k}" for k in range(1, LONG_AR + 1)]


def stage1_fit(train: DataFrame, x: str = "diff") -> DataFrame:
    """Stage-1 coefficients: (KEYS, coef, ssr, nobs), one row a series."""
    return _regress(_lagged(train, x).filter(F.col(f"x{LONG_AR}").isNotNull()), "x", AR_COLUMNS)


def stage_rows(train: DataFrame, coefficients: DataFrame, x: str = "diff", ar_lags: list[int] = AR_LAGS,
               ma_lags: list[int] = MA_LAGS) -> DataFrame:
    """Rows with x, the stage-1 residual e and their lags. ``coefficients``
    should be a written table (one row a series): its size lets Spark choose
    the join, and it is not fitted again for each use."""
    coef = coefficients.select(*KEYS, F.col("coef").alias("a"))
    rows = _lagged(train, x).join(coef, KEYS)
    rows = rows.selectExpr(*KEYS, "Data", "rn", "x", *[f"x{k}" for k in ar_lags],
                           f"CASE WHEN x{LONG_AR} IS NOT NULL THEN x - ({_dot('a', AR_COLUMNS)}) END AS e")
    return rows.selectExpr("*", *lags_sql("e", ma_lags, "e"))


def stage2_columns() -> list[str]:
    return [f"x{k}" for k in AR_LAGS] + [f"e{k}" for k in MA_LAGS]


def lag_regression_fit(rows: DataFrame) -> DataFrame:
    """Stage-2 coefficients per series from the rows of ``stage_rows``."""
    return _regress(rows.filter(F.col(f"e{max(MA_LAGS)}").isNotNull()), "x", stage2_columns())


def _forecast_one(horizon_col: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        coef = pdf["coef"].iloc[0]
        H = int(pdf[horizon_col].iloc[0])
        key = (pdf["nazwa_kasy"].iloc[0], pdf["measure"].iloc[0])
        if coef is None or H <= 0:
            return pd.DataFrame({"nazwa_kasy": [], "measure": [], "h": [], "pred_diff": []})
        depth = max(AR_LAGS)
        b, c = np.zeros(depth), np.zeros(depth)               # by lag, the nearest last
        b[-np.array(AR_LAGS)], c[-np.array(MA_LAGS)] = coef[:len(AR_LAGS)], coef[len(AR_LAGS):]
        xs, es = np.zeros(depth + H), np.zeros(depth + H)
        tail = pdf.iloc[-depth:]
        xs[depth - len(tail):depth] = np.nan_to_num(tail["x"].to_numpy(dtype=float))
        es[depth - len(tail):depth] = np.nan_to_num(tail["e"].to_numpy(dtype=float))
        for h in range(H):
            xs[depth + h] = b @ xs[h:h + depth] + c @ es[h:h + depth]
        out = xs[depth:]
        return pd.DataFrame({"nazwa_kasy": key[0], "measure": key[1], "h": np.arange(1, H + 1, dtype="int64"),
                             "pred_diff": out})
    return run


def forecast_from_rows(split: DataFrame, rows: DataFrame) -> DataFrame:
    """Test-period forecast for every series: (KEYS, Data, h, value, diff, y_T,
    pred_diff, pred_level) with pred_level = last training level + running
    sum of pred_diff. ``rows``: ``stage_rows`` of the training part."""
    from kasaflow.operators.series import running
    meta = split.groupBy(*KEYS).agg((F.max("n") - F.max("n_test")).alias("n_train"),
                                    F.max("n_test").alias("horizon"))
    tail = (rows.join(meta, KEYS).filter(F.col("rn") > F.col("n_train") - F.lit(max(AR_LAGS)))
            .select(*KEYS, "rn", "x", "e", "horizon").join(lag_regression_fit(rows).select(*KEYS, "coef"), KEYS))
    preds = tail.groupBy(*KEYS).applyInPandas(
        _forecast_one("horizon"), "nazwa_kasy string, measure string, h long, pred_diff double")
    test = split.filter(F.col("split") == "test").withColumn("h", F.col("rn") - (F.col("n") - F.col("n_test")))
    start = split.filter(F.col("rn") == F.col("n") - F.col("n_test")).select(*KEYS, F.col("value").alias("y_T"))
    out = test.join(preds, KEYS + ["h"], "left").join(start, KEYS, "left")
    out = out.withColumn("pred_level", F.col("y_T") + F.sum("pred_diff").over(running()))
    return out.select(*KEYS, "Data", "h", "value", "diff", "y_T", "pred_diff", "pred_level")


def lag_regression_forecast(split: DataFrame) -> DataFrame:
    """The whole chain without written intermediates (each series is fitted twice)."""
    from kasaflow.operators.series import train_series
    train = train_series(split)
    return forecast_from_rows(split, stage_rows(train, stage1_fit(train)))


# ---- order search --------------------------------------------------------------

MAX_ARMA, MAX_SEASONAL, MAX_SUM = 5, 2, 5
SEARCH_LAGS = sorted({i + SEASON * j for i in range(MAX_ARMA + 1) for j in range(MAX_SEASONAL + 1)} - {0})
# --- fixed values: published 5 % point of the KPSS level test, and the strength of a
# seasonal pattern from which the usual rule takes a seasonal difference
KPSS_5PCT = 0.463
SEASONAL_STRENGTH = 0.64


def kpss_level(x: np.ndarray) -> float:
    """KPSS statistic around a level, Bartlett weights, trunc(4 (n/100)^(1/4)) lags."""
    u = x - x.mean()
    n = len(u)
    lags = int(4 * (n / 100.0) ** 0.25)
    s2 = u @ u / n + 2 / n * sum((1 - k / (lags + 1)) * (u[k:] @ u[:n - k]) for k in range(1, lags + 1))
    return float((np.cumsum(u) ** 2).sum() / (n * n * s2)) if s2 > 0 else 0.0


def seasonal_strength(x: np.ndarray, s: int = SEASON) -> float:
    """1 - var(rest) / var(season + rest), by a moving average of one season and the means of its phases."""
    if len(x) < 3 * s:
        return 0.0
    trend = np.convolve(x, np.ones(s) / s, "valid")
    detrended = x[s // 2:s // 2 + len(trend)] - trend
    known = np.flatnonzero(~np.isnan(detrended))
    detrended, phase = detrended[known], known % s
    if len(np.unique(phase)) < s:
        return 0.0
    season = np.bincount(phase, detrended, s) / np.bincount(phase, minlength=s)
    total = detrended.var()
    return max(0.0, 1 - (detrended - season[phase]).var() / total) if total > 0 else 0.0


def strong_week(x: np.ndarray) -> bool:
    return seasonal_strength(x) > SEASONAL_STRENGTH


DIFFERENCED = "nazwa_kasy string, measure string, Data date, rn long, x double, d int, sd int"


def differencer(weekly: Callable[[np.ndarray], bool]):
    """One series, differenced as the tests say: (KEYS, Data, rn, x, d, sd). ``weekly`` decides on the seasonal
    difference, KPSS on the others. Values that are not known take no part: differences that touch them are not
    known either, and the tests look at the others."""
    def difference(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        x = pdf["x"].to_numpy(dtype=float)
        sd = int(weekly(x))
        z = x[SEASON:] - x[:-SEASON] if sd else x
        d = 0
        while d < 2 and (~np.isnan(z)).sum() > 10 and kpss_level(z[~np.isnan(z)]) > KPSS_5PCT:
            z, d = np.diff(z), d + 1
        kept = pdf.iloc[len(pdf) - len(z):]
        return pd.DataFrame({"nazwa_kasy": kept["nazwa_kasy"], "measure": kept["measure"], "Data": kept["Data"],
                             "rn": kept["rn"].astype("int64"), "x": [None if np.isnan(v) else v for v in z],
                             "d": np.int32(d), "sd": np.int32(sd)})
    return difference


def candidate_orders() -> list[tuple[int, int, int, int]]:
    ranges = (range(MAX_ARMA + 1), range(MAX_ARMA + 1), range(MAX_SEASONAL + 1), range(MAX_SEASONAL + 1))
    return [o for o in itertools.product(*ranges) if sum(o) <= MAX_SUM]


def _lags_for(p: int, P: int, s: int = SEASON) -> list[int]:
    return sorted({i + s * j for i in range(p + 1) for j in range(P + 1)} - {0})


def _order_search_one(pdf: pd.DataFrame) -> pd.DataFrame:
    cols = [f"x{k}" for k in SEARCH_LAGS] + [f"e{k}" for k in SEARCH_LAGS]
    at = {c: 1 + i for i, c in enumerate(cols)}
    G = matrix_from_rows(pdf["i"], pdf["g"])
    n = float(G[len(cols) + 1, len(cols) + 1])
    best, tried = None, 0
    for p, q, P, Q in candidate_orders():
        names = [f"x{k}" for k in _lags_for(p, P)] + [f"e{k}" for k in _lags_for(q, Q)]
        coef, ssr = [], float(G[0, 0])
        if names:
            fit = ols_from_gram(G, 0, [at[c] for c in names])
            if fit is None:
                continue
            coef, ssr = list(map(float, fit[0])), fit[1]
        if ssr <= 0 or n <= len(names):
            continue
        tried += 1
        found = (n * math.log(ssr / n) + 2.0 * len(names), len(names), p, q, P, Q)
        if best is None or found < best[0]:
            best = (found, names, coef)
    (aic, k, p, q, P, Q), names, coef = best or ((np.nan, 0, None, None, None, None), [], [])
    first = pdf.iloc[0]
    return pd.DataFrame([{"nazwa_kasy": first["nazwa_kasy"], "measure": first["measure"], "p": p, "d": first["d"], "q": q,
                          "sp": P, "sd": first["sd"], "sq": Q, "s": SEASON, "aic": float(aic), "n_params": int(k),
                          "n_candidates": tried, "terms": names, "coef": coef}])


SEARCH_COLUMNS = [f"x{k}" for k in SEARCH_LAGS] + [f"e{k}" for k in SEARCH_LAGS]


def search_gram(z: DataFrame, coef: DataFrame) -> DataFrame:
    """Gram rows of x and all lags of x and e that a candidate may use, over the rows that have them all (``gram_rows``)."""
    rows = stage_rows(z, coef, "x", SEARCH_LAGS, SEARCH_LAGS).filter(F.col(f"e{max(SEARCH_LAGS)}").isNotNull())
    return _gram_with_count(rows, "x", SEARCH_COLUMNS)


def order_search(split: DataFrame, x: str = "diff", write=lambda df, name: df) -> DataFrame:
    """Differencing and best (p, q, P, Q) per series with the terms' coefficients.
    ``write`` may store an intermediate table that is used twice."""
    from kasaflow.operators.series import train_series
    start = train_series(split).select(*KEYS, "Data", "rn", F.col(x).alias("x"))
    z = write(start.groupBy(*KEYS).applyInPandas(differencer(strong_week), DIFFERENCED), "search-series")
    coef = write(stage1_fit(z, "x"), "search-coef")
    g = search_gram(z, coef)
    orders = z.groupBy(*KEYS).agg(F.max("d").alias("d"), F.max("sd").alias("sd"))
    schema = ("nazwa_kasy string, measure string, p int, d int, q int, sp int, sd int, sq int, s int, aic double, "
              "n_params int, n_candidates int, terms array<string>, coef array<double>")
    return g.join(orders, KEYS).groupBy(*KEYS).applyInPandas(_order_search_one, schema)
