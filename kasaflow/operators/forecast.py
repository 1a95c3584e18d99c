"""Seasonal forecasts of every series, fitted by least squares in Spark.

Seasonal MA, orders (0,1,0)(0,1,1,s)
-----------------------------------
w_t = (1-B)(1-B^s) y_t = e_t + theta e_{t-s}. By conditional sum of squares
(e = 0 before the first w), e_t = w_t - theta e_{t-s}: the recursion splits
into s independent chains (t mod s). Theta is the minimum over (-1, 1), found
on a coarse grid and then on two finer ones around the best value so far
(``REFINE``), to 0.0005. The recursion is sequential, so it runs per series in
``applyInPandas``: a series is a matrix of (T / s, s), and numpy folds all s
chains and all candidate thetas of a grid at once, row by row. A series holds
one row per training day: its size is bounded by the calendar span, not by the
data volume. A NULL in the series leaves its chain as it is.

The forecast needs no recursion: with v = (1-B) y and h' = ((h-1) mod s) + 1,
v_hat(T+h) = v(T+h'-s) + theta e(T+h'-s), and y_hat = y_T + running sum of
v_hat. The anchors (last training row of each phase) are joined to the test
rows on (series, phase), so the test rows never pass through Python.

This estimates the same model family as an exact-likelihood state-space fit,
not the same numbers: theta is the CSS minimiser.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kasaflow.operators.series import KEYS, running

SEASON = 7
# Coarse grid for theta: -0.95, -0.90, ..., 0.95 (39 values).
THETA_GRID = [round(-0.95 + 0.05 * i, 2) for i in range(39)]
# Then -9..9 steps around the best: up to the neighbouring value of the grid before.
REFINE = [(0.005, 3), (0.0005, 4)]  # (step, decimals)


FIT_SCHEMA = ("nazwa_kasy string, measure string, phase int, theta double, css double, "
              "e_last double, v double, y_T double")


def _fold(w: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last residual of each chain, sum of squares) for every theta; ``w`` is
    (steps, chains), NaN where there is no value."""
    e = np.zeros((w.shape[1], len(grid)))
    sse = np.zeros_like(e)
    for row in w:
        here = ~np.isnan(row)[:, None]
        e = np.where(here, row[:, None] - grid * e, e)
        sse += np.where(here, e * e, 0.0)
    return e, sse.sum(axis=0)


def _fit_one_series(thetas: list[float], s: int, on: str, refine: list[tuple[float, int]]):
    coarse = np.asarray(thetas, dtype=float)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        y = pdf[on].to_numpy(dtype=float)
        v = pdf["diff"].to_numpy(dtype=float)
        rn = pdf["rn"].to_numpy()
        T = len(y)
        # w_t = (1-B)(1-B^s) y_t, defined from the (s+2)-th row on; chain = rn mod s
        w = ((y[s + 1:] - y[s:-1]) - y[1:T - s]) + y[:T - s - 1] if T > s + 1 else np.zeros(0)
        lead = int(rn[s + 1] % s) if T > s + 1 else 0
        table = np.concatenate((np.full(lead, np.nan), w, np.full(-(lead + len(w)) % s, np.nan))).reshape(-1, s)
        grid = coarse
        for step, places in [*refine, (None, 0)]:
            e, css = _fold(table, grid)
            k = int(np.argmin(css))  # the smallest theta on ties
            if step is not None:
                grid = np.round(grid[k] + step * np.arange(-9, 10), places)
        last = np.arange(max(0, T - s), T)
        phase = rn[last] % s
        return pd.DataFrame({"nazwa_kasy": pdf["nazwa_kasy"].iloc[0], "measure": pdf["measure"].iloc[0],
                             "phase": phase.astype("int32"), "theta": float(grid[k]), "css": float(css[k]),
                             "e_last": e[phase, k], "v": np.where(last > 0, v[last], np.nan), "y_T": float(y[-1])})
    return fit


def seasonal_ma_fit(split: DataFrame, thetas: list[float] = THETA_GRID, on: str = "value",
                    s: int = SEASON, refine: list[tuple[float, int]] = REFINE) -> DataFrame:
    """Theta by conditional least squares, per series, plus the forecast
    anchors: one row per phase with the last training residual
    ``e_last``, first difference ``v`` and the last training level ``y_T``.

    One group per series (its training days, bounded by the calendar span).
    Inside, the s chains are folded for all candidates of a grid at once.
    """
    train = split.filter(F.col("split") == "train").select(*KEYS, "rn", F.col(on), "diff")
    return train.groupBy(*KEYS).applyInPandas(_fit_one_series(list(thetas), s, on, refine), FIT_SCHEMA)


def seasonal_ma_forecast(split: DataFrame, thetas: list[float] = THETA_GRID, on: str = "value",
                         s: int = SEASON, fixed_theta: float | None = None) -> DataFrame:
    """Forecast of the test days of every series.

    Returns (KEYS, Data, h, value, diff, y_T, theta, pred_diff, pred_level).
    ``fixed_theta`` skips the search and uses that value (grid of one).
    """
    grid = [fixed_theta] if fixed_theta is not None else thetas
    anchors = seasonal_ma_fit(split, grid, on, s, [] if fixed_theta is not None else REFINE)
    test = (split.filter(F.col("split") == "test")
            .withColumn("phase", (F.col("rn") % F.lit(s)).cast("int")))
    joined = test.join(anchors, KEYS + ["phase"], "left")
    out = joined.withColumn("pred_diff", F.col("v") + F.col("theta") * F.col("e_last"))
    out = out.withColumn("pred_level", F.col("y_T") + F.sum("pred_diff").over(running()))
    return out.select(*KEYS, "Data", (F.col("rn") - (F.col("n") - F.col("n_test"))).alias("h"),
                      F.col(on).alias("value"), "diff", "y_T", "theta", "pred_diff", "pred_level")


def forecast_metrics(fc: DataFrame, model: str | None = None, digits: int = 6) -> DataFrame:
    """RMSE, MAE and R^2 of predicted vs actual test differences per series.

    R^2 uses the usual total sum of squares sum((y - mean y)^2). The window
    and the grouped sums share the (series) partitioning: one shuffle.
    """
    resid = F.col("diff") - F.col("pred_diff")
    dev = F.col("diff") - F.avg("diff").over(Window.partitionBy(*KEYS))
    g = fc.withColumns({"r": resid, "dev": dev}).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rmse"),
        F.avg(F.abs("r")).alias("mae"),
        F.sum(F.col("r") * F.col("r")).alias("sse"),
        F.sum(F.col("dev") * F.col("dev")).alias("sst"))
    r2 = F.lit(1.0) - F.try_divide(F.col("sse"), F.col("sst"))
    out = g.select(*KEYS, "n", F.round("rmse", digits).alias("rmse"), F.round("mae", digits).alias("mae"),
                   F.round(r2, digits).alias("r2"))
    if model is not None:
        out = out.withColumn("model", F.lit(model))
    return out


def residuals(fc: DataFrame) -> DataFrame:
    return fc.select(*KEYS, "Data", (F.col("diff") - F.col("pred_diff")).alias("resid"))


def forecast_compare(fc: DataFrame, digits: int = 2) -> DataFrame:
    """Actual vs predicted levels: difference and ratio (pred / orig x 100),
    both rounded. The actual level is rebuilt like the predicted one (last
    training value + running sum of the test differences) and rounded to
    ``digits`` (cents), which restores exact values such as 0. A zero actual
    gives a NULL ratio."""
    orig = F.round(F.col("y_T") + F.sum("diff").over(running()), digits)
    out = fc.withColumn("dane_oryg", orig).withColumn("dane_pred", F.col("pred_level"))
    return out.select(*KEYS, "Data", "h", "dane_oryg",
                      F.round("dane_pred", digits).alias("dane_pred"),
                      F.round(F.col("dane_oryg") - F.col("dane_pred"), digits).alias("roznica"),
                      F.round(F.try_divide(F.col("dane_pred"), F.col("dane_oryg")) * F.lit(100.0), digits)
                      .alias("roznica_%"))


def mean_ratio(compare: DataFrame) -> DataFrame:
    """Average of ``roznica_%`` per series (exact sum of the 2-place values)."""
    r = F.col("`roznica_%`")
    return compare.groupBy(*KEYS).agg(
        (F.sum(r.cast("decimal(38,2)")).cast("double") / F.count(r)).alias("srednia_roznica"))
