"""Series diagnostics: augmented Dickey-Fuller, partial autocorrelation,
Ljung-Box. Data passes are Spark window + grouped aggregates; per-series
solves run on matrices of at most (lags + 3)^2 numbers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kasaflow.functions.stats import adf_critical, adf_pvalue, chi2_sf_col, levinson_pacf
from kasaflow.operators.series import KEYS

ADF_SCHEMA = ("nazwa_kasy string, measure string, adf_stat double, p_value double, used_lag int, "
              "nobs int, crit_1pct double, crit_5pct double, crit_10pct double, stationary boolean")
ADF_LEVEL = 0.05


def with_verdict(adf: DataFrame, level: float = ADF_LEVEL) -> DataFrame:
    """Adds the test verdict at ``level``: unit root rejected (stationary) or not."""
    return adf.withColumn("verdict", F.when(F.col("p_value") <= level, "stationary")
                          .when(F.col("p_value") > level, "possibly non-stationary"))


def adf_max_lag(n: int) -> int:
    """Schwert's rule capped at n/2 - 2 (constant-only regression); below 0 the series is too short."""
    return min(n // 2 - 2, math.ceil(12.0 * (n / 100.0) ** 0.25))


def _standardised(x: np.ndarray) -> np.ndarray:
    """The t statistic and the AIC ranking do not change with scale and level; the Gram matrix is far better
    conditioned."""
    sd = x.std(ddof=1) if len(x) > 1 else 0.0
    return (x - x.mean()) / sd if sd > 0 else np.zeros_like(x)


def _adf_columns(z: np.ndarray, lags: int, first: int) -> tuple[np.ndarray, ...]:
    """y = dz, ones, z one day before, and a column a lag of dz (0 before the series), for days ``first``.. (views
    of one array: a lag is a shift)."""
    dz = np.diff(z)
    padded = np.concatenate((np.zeros(lags), dz))
    days = np.arange(first - 1, len(dz))
    shifted = [padded[lags - k + first - 1:lags - k + len(dz)] for k in range(1, lags + 1)]
    return dz[days], np.ones(len(days)), z[days], *shifted


def _gram_of(columns: tuple[np.ndarray, ...]) -> np.ndarray:
    X = np.stack(columns)
    return X @ X.T


def eliminated(G: np.ndarray, pivots: int, tiny: float = 1e-10) -> Iterator[np.ndarray]:
    """The Gram matrix with its first 0, 1, ... columns taken out of the others (the steps of one Cholesky factor).
    Ends early where a column depends on those before it."""
    G = G.astype(float).copy()
    size = np.diag(G).copy()
    yield G
    for k in range(pivots):
        if G[k, k] <= tiny * max(size[k], 1e-300):
            return
        G[k + 1:, k + 1:] -= np.outer(G[k + 1:, k], G[k, k + 1:]) / G[k, k]
        yield G


def adf_statistic(x: np.ndarray) -> tuple[float, int, int] | None:
    """(statistic, lag, nobs) of one series. The residual sums of all lags come from one elimination of the Gram
    matrix of the days that every lag has; the chosen lag is fitted again on all days it has."""
    n = len(x)
    top = adf_max_lag(n)
    if top < 0:
        return None
    z = _standardised(x)
    y, one, before, *lagged = _adf_columns(z, top, top + 1)
    rows = len(y)
    best = None
    for k, G in enumerate(eliminated(_gram_of((one, before, *lagged, y)), top + 2)):
        ssr = G[-1, -1]
        if k >= 2 and ssr > 0:
            aic = rows * (math.log(2 * math.pi) + math.log(ssr / rows) + 1.0) + 2.0 * k
            best = (aic, k - 2) if best is None or (aic, k - 2) < best else best
    if best is None:
        return None
    p = best[1]
    y, one, before, *lagged = _adf_columns(z, p, p + 1)
    steps = list(eliminated(_gram_of((one, *lagged, before, y)), p + 1))
    dof = len(y) - (p + 2)
    if len(steps) <= p + 1 or dof <= 0:
        return None
    (sxx, sxy), (_, syy) = steps[-1][-2:, -2:]
    ssr = syy - sxy * sxy / sxx if sxx > 0 else 0.0
    if sxx <= 0 or ssr <= 0:
        return None
    return sxy / sxx / math.sqrt(ssr / dof / sxx), p, len(y)


def _values(pdf: pd.DataFrame) -> Iterator[tuple[dict, np.ndarray]]:
    for i, y in enumerate(pdf["y"]):
        yield {k: pdf[k].iloc[i] for k in KEYS}, np.asarray(y, dtype=float)


def _adf_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for key, x in _values(pdf):
            row = dict(key, adf_stat=np.nan, p_value=np.nan, used_lag=None, nobs=None,
                       crit_1pct=np.nan, crit_5pct=np.nan, crit_10pct=np.nan, stationary=None)
            found = adf_statistic(x)
            if found is not None:
                stat, lag, nobs = found
                crit, pval = adf_critical(nobs), adf_pvalue(stat)
                row.update(adf_stat=float(stat), p_value=pval, used_lag=lag, nobs=nobs, crit_1pct=crit["1%"],
                           crit_5pct=crit["5%"], crit_10pct=crit["10%"], stationary=bool(pval <= ADF_LEVEL))
            out.append(row)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ADF_SCHEMA.split(", ")])


def _gram_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for key, x in _values(pdf):
            top = adf_max_lag(len(x))
            if top >= 0 and len(x) > top + 1:
                G = _gram_of(_reordered(_adf_columns(_standardised(x), top, top + 1)))
                yield pd.DataFrame(key | {"n": len(x), "L": top, "i": np.arange(len(G)), "g": list(G)})


def _reordered(columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    y, one, before, *lagged = columns
    return y, before, one, *lagged


def _series_values(diffed: DataFrame, column: str) -> DataFrame:
    """One row a series: its non-NULL values in order; the calendar bounds the array."""
    x = diffed.filter(F.col(column).isNotNull())
    pairs = F.sort_array(F.collect_list(F.struct("Data", F.col(column).cast("double").alias("x"))))
    return x.groupBy(*KEYS).agg(F.transform(pairs, lambda p: p["x"]).alias("y"))


def adf_gram(diffed: DataFrame, column: str = "diff") -> DataFrame:
    """Common-sample Gram matrix of each series' ADF design (dz, z before, 1, dz lags), long form (KEYS, n, L, i, g)."""
    return _series_values(diffed, column).mapInPandas(
        _gram_batch, "nazwa_kasy string, measure string, n long, L int, i int, g array<double>")


def adf_test(diffed: DataFrame, column: str = "diff") -> DataFrame:
    """Augmented Dickey-Fuller test (constant, lag by AIC up to Schwert's rule)
    of every series: statistic, MacKinnon p-value, lag, nobs, critical values.

    One shuffle brings a series' days together; its largest lag, the Gram
    matrix and both fits are worked out there. Nothing runs before the action.
    """
    return _series_values(diffed, column).mapInPandas(_adf_batch, ADF_SCHEMA)


def _pacf_solve(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("lag")
    vals = levinson_pacf(pdf["acf"].to_numpy(dtype=float))
    return pd.DataFrame({"nazwa_kasy": pdf["nazwa_kasy"].iloc[0], "measure": pdf["measure"].iloc[0],
                         "lag": pdf["lag"].to_numpy(dtype="int32"), "pacf": np.round(vals, 9)})


def pacf(acf_df: DataFrame) -> DataFrame:
    """Partial autocorrelations (Yule-Walker on the biased ACF, 'ywm') from the
    ACF rows of each series (nlags + 1 rows per group)."""
    return (acf_df.select(*KEYS, "lag", "acf").groupBy(*KEYS)
            .applyInPandas(_pacf_solve, "nazwa_kasy string, measure string, lag int, pacf double"))


Z95 = 1.959963984540054  # two-sided 95 % point of the normal distribution


def acf_bounds(acf_df: DataFrame) -> DataFrame:
    """(KEYS, lag, acf, bound): 95 % bounds around 0 by Bartlett's formula,
    z * sqrt((1 + 2 * sum of the squared earlier r) / n); lag 0 has none."""
    from pyspark.sql import Window
    earlier = Window.partitionBy(*KEYS).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    sq = F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf"))).over(earlier)
    var = (F.lit(1.0) + F.lit(2.0) * F.coalesce(sq, F.lit(0.0))) / F.col("nobs")
    bound = F.when(F.col("lag") > 0, F.lit(Z95) * F.sqrt(var)).otherwise(F.lit(0.0))
    return acf_df.select(*KEYS, "lag", F.round("acf", 9).alias("acf"), F.round(bound, 9).alias("bound"))


def pacf_bounds(acf_df: DataFrame) -> DataFrame:
    """(KEYS, lag, pacf, bound): z / sqrt(n) for every lag but 0."""
    n = acf_df.where("lag = 0").select(*KEYS, "nobs")
    bound = F.when(F.col("lag") > 0, F.lit(Z95) / F.sqrt("nobs")).otherwise(F.lit(0.0))
    return pacf(acf_df).join(n, KEYS).select(*KEYS, "lag", "pacf", F.round(bound, 9).alias("bound"))


def ljung_box(resid: DataFrame, order_col: str = "Data", value_col: str = "resid",
              group: list[str] | None = None, lag: int = 1) -> DataFrame:
    """Ljung-Box Q at ``lag`` lags per group (default lag 1):
    Q = n (n + 2) sum_k r_k^2 / (n - k), r_k the biased autocorrelation of the
    demeaned values."""
    group = group or KEYS
    from pyspark.sql import Window
    w = Window.partitionBy(*group).orderBy(order_col)
    wa = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = resid.filter(F.col(value_col).isNotNull())
    x = x.withColumn("u", F.col(value_col) - F.avg(value_col).over(wa))
    x = x.withColumns({f"l{k}": F.lag("u", k).over(w) for k in range(1, lag + 1)})
    g = x.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("u") * F.col("u")).alias("s0"),
                              *[F.sum(F.col("u") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, lag + 1)])
    n = F.col("n").cast("double")
    terms = [F.pow(F.try_divide(F.coalesce(F.col(f"s{k}"), F.lit(0.0)), F.col("s0")), 2) / (n - F.lit(k))
             for k in range(1, lag + 1)]
    q = n * (n + F.lit(2.0)) * sum(terms[1:], terms[0])
    return g.select(*group, "n", F.lit(lag).alias("lags"), q.alias("lb_stat"))


def with_ljung_box_pvalue(lb: DataFrame) -> DataFrame:
    """Adds the chi-square(lags) upper tail."""
    return lb.withColumn("lb_pvalue", chi2_sf_col(F.col("lb_stat"), F.col("lags")))
