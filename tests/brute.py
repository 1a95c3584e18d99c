"""Plain numpy re-statements of the published procedures, used as brute-force
references on small inputs."""

import math

import numpy as np


def adfuller_c(x: np.ndarray):
    """ADF with constant, lag by AIC from 0..maxlag on a common sample, refit
    at the chosen lag (the usual textbook/statsmodels procedure), by direct
    least squares on the explicit design matrices."""
    x = np.asarray(x, dtype=float)
    n = len(x)
    maxlag = min(n // 2 - 2, int(math.ceil(12.0 * (n / 100.0) ** 0.25)))
    dx = np.diff(x)

    def design(L):
        rows = []
        ys = []
        for i in range(L, len(dx)):
            rows.append([1.0, x[i]] + [dx[i - k] for k in range(1, L + 1)])
            ys.append(dx[i])
        return np.array(rows), np.array(ys)

    X, y = design(maxlag)
    best = None
    for p in range(0, maxlag + 1):
        Xp = X[:, :p + 2]
        beta, *_ = np.linalg.lstsq(Xp, y, rcond=None)
        ssr = float(((y - Xp @ beta) ** 2).sum())
        nobs = len(y)
        llf = -nobs / 2 * (math.log(2 * math.pi) + math.log(ssr / nobs) + 1)
        cand = (-2 * llf + 2 * (p + 2), p)
        best = cand if best is None or cand < best else best
    p = best[1]
    X, y = design(p)
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    resid = y - X @ beta
    nobs = len(y)
    s2 = float(resid @ resid) / (nobs - X.shape[1])
    cov = s2 * np.linalg.inv(X.T @ X)
    t = beta[1] / math.sqrt(cov[1, 1])
    return t, p, nobs


def acf_biased(x, nlags):
    x = np.asarray(x, dtype=float)
    u = x - x.mean()
    d = (u * u).sum()
    return np.array([(u[k:] * u[:len(u) - k]).sum() / d for k in range(nlags + 1)])


def pacf_yw(x, nlags):
    r = acf_biased(x, nlags)
    out = [1.0]
    for k in range(1, nlags + 1):
        R = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        phi = np.linalg.solve(R, r[1:k + 1])
        out.append(phi[-1])
    return np.array(out)


def seasonal_ma_css(y, thetas, s=7):
    """(1-B)(1-B^s) y = (1 + theta B^s) e by conditional sum of squares on a
    grid; returns (theta, sse, e) for the best theta (smallest theta on ties)."""
    y = np.asarray(y, dtype=float)
    T = len(y)
    w = np.full(T, np.nan)
    for t in range(s + 1, T):
        w[t] = y[t] - y[t - 1] - y[t - s] + y[t - s - 1]
    best = None
    for th in thetas:
        e = np.zeros(T)
        sse = 0.0
        for t in range(s + 1, T):
            prev = e[t - s] if t - s >= s + 1 else 0.0
            e[t] = w[t] - th * prev
            sse += e[t] * e[t]
        if best is None or sse < best[1]:
            best = (th, sse, e.copy())
    return best


def seasonal_ma_refined(y, s=7):
    """The best theta on the coarse grid, then on two finer ones around it."""
    grid = [round(-0.95 + 0.05 * i, 2) for i in range(39)]
    best = seasonal_ma_css(y, grid, s)
    for step, places in ((0.005, 3), (0.0005, 4)):
        best = seasonal_ma_css(y, [round(best[0] + step * i, places) for i in range(-9, 10)], s)
    return best


def seasonal_ma_forecast(y, theta, e, h, s=7):
    y = np.asarray(y, dtype=float)
    T = len(y)
    v = np.diff(y, prepend=np.nan)
    out = []
    level = y[-1]
    vhat = {}
    for i in range(1, h + 1):
        t = T - 1 + i
        if i <= s:
            val = v[t - s] + theta * (e[t - s] if t - s < T else 0.0)
        else:
            val = vhat[t - s]
        vhat[t] = val
        level = level + val
        out.append((val, level))
    return out


def hannan_rissanen(x, ar_lags, ma_lags, long_ar, horizon):
    """Two-stage least squares by explicit design matrices; forecast recursion."""
    x = np.asarray(x, dtype=float)
    T = len(x)
    rows = [[x[t - k] for k in range(1, long_ar + 1)] for t in range(long_ar, T)]
    a, *_ = np.linalg.lstsq(np.array(rows), x[long_ar:], rcond=None)
    e = np.full(T, np.nan)
    for t in range(long_ar, T):
        e[t] = x[t] - np.dot(a, [x[t - k] for k in range(1, long_ar + 1)])
    start = long_ar + max(ma_lags)
    X2 = [[x[t - k] for k in ar_lags] + [e[t - k] for k in ma_lags] for t in range(start, T)]
    coef, *_ = np.linalg.lstsq(np.array(X2), x[start:], rcond=None)
    b, c = coef[:len(ar_lags)], coef[len(ar_lags):]
    xs = list(x)
    es = [0.0 if np.isnan(v) else v for v in e]
    out = []
    for h in range(1, horizon + 1):
        t = T - 1 + h
        val = sum(bk * xs[t - k] for bk, k in zip(b, ar_lags)) + \
            sum(ck * (es[t - k] if t - k < T else 0.0) for ck, k in zip(c, ma_lags))
        xs.append(val)
        out.append(val)
    return coef, out
