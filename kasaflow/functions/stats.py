"""Distribution functions and published test tables (Python, used inside
per-series numpy steps and through a vectorised pandas UDF)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: MacKinnon (1994, 2010) response surfaces, constant only,
# one variable (ADF with regression 'c'). Published constants.
ADF_C_TAU_MAX = 2.74
ADF_C_TAU_MIN = -18.83
ADF_C_TAU_STAR = -1.61
ADF_C_SMALL_P = [2.1659, 1.4412, 0.038269]               # p = Phi(b0 + b1 t + b2 t^2)
ADF_C_LARGE_P = [1.7339, 0.93202, -0.12745, -0.010368]    # p = Phi(b0 + b1 t + b2 t^2 + b3 t^3)
ADF_C_CRIT = {                                             # b0 + b1/T + b2/T^2 + b3/T^3
    "1%": [-3.43035, -6.5393, -16.786, -79.433],
    "5%": [-2.86154, -2.8903, -4.234, -40.040],
    "10%": [-2.56677, -1.5384, -2.809, 0.0],
}


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def adf_pvalue(stat: float) -> float:
    """MacKinnon approximate p-value of an ADF statistic (constant, N = 1)."""
    if math.isnan(stat):
        return float("nan")
    if stat > ADF_C_TAU_MAX:
        return 1.0
    if stat < ADF_C_TAU_MIN:
        return 0.0
    coef = ADF_C_SMALL_P if stat <= ADF_C_TAU_STAR else ADF_C_LARGE_P
    return norm_cdf(sum(c * stat ** i for i, c in enumerate(coef)))


def adf_critical(nobs: int) -> dict[str, float]:
    return {k: sum(c / nobs ** i for i, c in enumerate(v)) for k, v in ADF_C_CRIT.items()}


def chi2_sf(q: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Upper tail of chi-square: the regularised upper gamma function of
    (df / 2, q / 2), by its series below a + 1 and by Lentz's continued
    fraction above, for whole arrays."""
    q, df = np.asarray(q, float), np.asarray(df, float)
    a, x = df / 2.0, np.maximum(q, 0.0) / 2.0
    log_gamma = np.array([math.lgamma(v) if v > 0 else np.nan for v in a.ravel()]).reshape(a.shape)
    with np.errstate(all="ignore"):
        front = np.where(x > 0, np.exp(-x + a * np.log(np.where(x > 0, x, 1.0)) - log_gamma), 0.0)
        term = total = 1.0 / a
        for k in range(1, 500):
            term = term * x / (a + k)
            total = total + term
        low = 1.0 - front * total
        tiny = 1e-300
        b = x + 1.0 - a
        c, d = np.full_like(x, 1.0 / tiny), 1.0 / np.where(b == 0, tiny, b)
        h = d
        for k in range(1, 500):
            an = -k * (k - a)
            b = b + 2.0
            d = an * d + b
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        return np.where(x <= 0, 1.0, np.where(x < a + 1.0, low, front * h)) + q * 0.0


@F.pandas_udf(T.DoubleType())
def _chi2_sf_udf(q: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf(q.to_numpy(dtype=float), df.to_numpy(dtype=float)))


def chi2_sf_col(q: Column, df: Column) -> Column:
    """Vectorised (Arrow batch) p-value column; one value per series."""
    return _chi2_sf_udf(q, df)


def levinson_pacf(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations phi_kk, k = 0..len(r)-1, from autocorrelations
    r[0..K] (Durbin-Levinson; equals Yule-Walker with the biased ACF)."""
    K = len(r) - 1
    out = np.full(K + 1, np.nan)
    out[0] = 1.0
    if K == 0 or not np.isfinite(r).all() or r[0] == 0:
        return out
    phi = np.zeros(K + 1)
    v = r[0]
    for k in range(1, K + 1):
        acc = r[k] - np.dot(phi[1:k], r[k - 1:0:-1])
        if v <= 0:
            break
        pk = acc / v
        new = phi.copy()
        new[k] = pk
        new[1:k] = phi[1:k] - pk * phi[k - 1:0:-1]
        phi = new
        v = v * (1.0 - pk * pk)
        out[k] = pk
    return out
