"""Seasonal ARMA models of many series at once (numpy; the bodies of Spark's batches).

A model of orders (p, d, q)(P, D, Q, s) is

    (1 - ar(B)) (1 - sar(B^s)) w = (1 + ma(B)) (1 + sma(B^s)) e,   w = (1 - B)^d (1 - B^s)^D y.

Arrays carry one series, or one parameter vector of one series, a row: a batch
walks through time together. Factors are kept as partial autocorrelations inside
a box, so every model on the way is stationary and invertible.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

BOUND = 0.999                 # of partial autocorrelations
DIGITS = 4                    # of reported coefficients: far below their standard errors
STEPS = np.array([1.0, 0.5, 0.25, 0.1, 0.02, 0.002])


@dataclass(frozen=True)
class Orders:
    p: int
    d: int
    q: int
    P: int = 0
    D: int = 0
    Q: int = 0
    s: int = 7

    @property
    def sizes(self) -> tuple[int, int, int, int]:
        return self.p, self.P, self.q, self.Q

    @property
    def n(self) -> int:
        return sum(self.sizes)

    @property
    def lost(self) -> int:
        """Values that the differences cost."""
        return self.d + self.D * self.s

    def names(self) -> list[str]:
        kinds = (("ar", self.p, 1), ("sar", self.P, self.s), ("ma", self.q, 1), ("sma", self.Q, self.s))
        return [f"{kind}{k * step}" for kind, size, step in kinds for k in range(1, size + 1)]

    def factors(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, np.cumsum(self.sizes)[:-1], axis=1)


# ---- polynomials ---------------------------------------------------------------------------------

def from_partials(r: np.ndarray) -> np.ndarray:
    """Coefficients of the stationary autoregressions with the given partial autocorrelations."""
    a = r[:, :0]
    for j in range(r.shape[1]):
        a = np.hstack([a - r[:, j:j + 1] * a[:, ::-1], r[:, j:j + 1]])
    return a


def to_partials(a: np.ndarray) -> np.ndarray:
    """The inverse; what is not stationary is moved to the edge of the box."""
    out = np.empty_like(a, dtype=float)
    for j in reversed(range(a.shape[1])):
        out[:, j] = np.clip(a[:, j], -BOUND, BOUND)
        r = out[:, j:j + 1]
        a = (a[:, :j] + r * a[:, :j][:, ::-1]) / (1 - r * r)
    return out


def coefficients(orders: Orders, partials: np.ndarray) -> np.ndarray:
    """The factors' coefficients; a moving average is an autoregression with the sign turned."""
    ar, sar, ma, sma = orders.factors(partials)
    return np.hstack([from_partials(ar), from_partials(sar), -from_partials(-ma), -from_partials(-sma)])


def partials(orders: Orders, coefs: np.ndarray) -> np.ndarray:
    ar, sar, ma, sma = orders.factors(coefs)
    return np.hstack([to_partials(ar), to_partials(sar), -to_partials(-ma), -to_partials(-sma)])


def _times(a: np.ndarray, b: np.ndarray, s: int) -> np.ndarray:
    """(1 + a(B)) (1 + b(B^s)) - 1, coefficients of B, B^2, ..."""
    out = np.zeros((len(a), a.shape[1] + s * b.shape[1]))
    out[:, :a.shape[1]] = a
    for j in range(b.shape[1]):
        at = s * (j + 1)
        out[:, at - 1] += b[:, j]
        out[:, at:at + a.shape[1]] += a * b[:, j:j + 1]
    return out


def expand(orders: Orders, coefs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the multiplied factors: w_t = phi . past w + e_t + theta . past e."""
    ar, sar, ma, sma = orders.factors(coefs)
    return -_times(-ar, -sar, orders.s), _times(ma, sma, orders.s)


def difference(orders: Orders, y: np.ndarray) -> np.ndarray:
    for _ in range(orders.d):
        y = y[:, 1:] - y[:, :-1]
    for _ in range(orders.D):
        y = y[:, orders.s:] - y[:, :-orders.s]
    return y


# ---- likelihood ----------------------------------------------------------------------------------

def _start(phi: np.ndarray, theta: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """R and the stationary state covariance P = T P T' + R R' (innovation variance 1), by doubling."""
    n = len(phi)
    R = np.zeros((n, m))
    R[:, 0] = 1.0
    R[:, 1:1 + theta.shape[1]] = theta
    A = np.zeros((n, m, m))
    A[:, :phi.shape[1], 0] = phi
    A[:, np.arange(m - 1), np.arange(1, m)] = 1.0
    P = R[:, :, None] * R[:, None, :]
    for _ in range(40):
        step = A @ P @ A.transpose(0, 2, 1)
        P = P + step
        if np.abs(step).max(initial=0.0) <= 1e-14 * np.abs(P).max(initial=1.0):
            break
        A = A @ A
    return R, P


def _on(phi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """T x for the companion matrix T: one lag on."""
    out = np.zeros_like(x)
    out[:, :-1] = x[:, 1:]
    out[:, :phi.shape[1]] += phi * x[:, :1]
    return out


def innovations(w: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, ...]:
    """Kalman filter of a batch: (sum of v^2 / F, sum of log F, values, state after the last one), with
    the innovation variance taken out. NaN is a value not seen.

    The stationary start is the diffuse start of the undifferenced model. Complete series need no
    covariance matrices: the changes of the stationary one have rank 1 (Chandrasekhar's recursion)."""
    n, length = w.shape
    m = max(phi.shape[1], theta.shape[1] + 1)
    R, P = _start(phi, theta, m)
    a = np.zeros((n, m))
    ssq, logs = np.zeros(n), np.zeros(n)
    seen = ~np.isnan(w)
    if seen.all():
        F = P[:, 0, 0].copy()
        K = _on(phi, P[:, :, 0])
        L, M = K.copy(), -1.0 / F
        steady = False
        for t in range(length):
            v = w[:, t] - a[:, 0]
            ssq += v * v / F
            logs += np.log(F)
            a = _on(phi, a) + K * (v / F)[:, None]
            if not steady:
                front = L[:, 0]
                new = F + M * front * front
                K = K + _on(phi, L) * (M * front)[:, None]
                M, old = M + (M * front) ** 2 / F, M
                L = _on(phi, L) - K * (front / new)[:, None]
                F = new
                steady = t % 16 == 0 and bool((np.abs(old) * front * front).max(initial=0.0) < 1e-15
                                              and (np.abs(old)[:, None] * L * L).max(initial=0.0) < 1e-15)
        return ssq, logs, seen.sum(1), a
    Q = R[:, :, None] * R[:, None, :]
    for t in range(length):
        here = seen[:, t]
        F = np.where(here, P[:, 0, 0], 1.0)
        v = np.where(here, np.nan_to_num(w[:, t]) - a[:, 0], 0.0)
        ssq += v * v / F
        logs += np.log(F)
        g = np.where(here[:, None], P[:, :, 0], 0.0)
        a = _on(phi, a + g * (v / F)[:, None])
        P = P - g[:, :, None] * (g / F[:, None])[:, None, :]
        P = _on_both(phi, P) + Q
    return ssq, logs, seen.sum(1), a


def _on_both(phi: np.ndarray, P: np.ndarray) -> np.ndarray:
    """T P T' for the companion matrix T."""
    k = phi.shape[1]
    half = np.zeros_like(P)
    half[:, :-1] = P[:, 1:]
    half[:, :k] += phi[:, :, None] * P[:, :1]
    out = np.zeros_like(P)
    out[:, :, :-1] = half[:, :, 1:]
    out[:, :, :k] += half[:, :, :1] * phi[:, None, :]
    return out


def log_likelihood(w: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihood at the best innovation variance, that variance), exact for Gaussian series."""
    ssq, logs, n, _ = innovations(w, phi, theta)
    n = np.maximum(n, 1)
    sigma2 = ssq / n
    with np.errstate(divide="ignore"):
        return -0.5 * (n * (np.log(2 * math.pi * sigma2) + 1) + logs), sigma2


# ---- fit -----------------------------------------------------------------------------------------

def minimise(f: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, bound: float = BOUND,
             rounds: int = 100, h: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Smallest f of every row within the box, by quasi-Newton steps (BFGS; directions that leave the
    box are left out). ``f(points, rows)`` gives the values of a batch. Returns (points, settled)."""
    n, k = x.shape
    x = np.clip(x, -bound, bound)
    settled = np.zeros(n, bool)
    if k == 0 or n == 0:
        return x, ~settled

    def gradient(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        moves = h * np.vstack([np.eye(k), -np.eye(k)])
        both = f((points[:, None] + moves).reshape(-1, k), np.repeat(rows, 2 * k)).reshape(-1, 2, k)
        return (both[:, 0] - both[:, 1]) / (2 * h)

    everyone = np.arange(n)
    value, g = f(x, everyone), gradient(x, everyone)
    H, plain = np.tile(np.eye(k), (n, 1, 1)), np.ones(n, bool)
    for _ in range(rounds):
        free = ~(((x >= bound) & (g < 0)) | ((x <= -bound) & (g > 0)))
        gf = np.where(free, g, 0.0)
        settled |= np.abs(gf).max(1) < 1e-8
        rows = np.flatnonzero(~settled)
        if not len(rows):
            break
        d = np.where(free[rows], -np.einsum("nij,nj->ni", H[rows], gf[rows]), 0.0)
        up = (d * gf[rows]).sum(1) >= 0
        d[up], plain[rows[up]] = -gf[rows[up]], True
        H[rows[up]] = np.eye(k)
        long = np.maximum(np.abs(d).max(1, keepdims=True), 0.5) / 0.5   # at most half a unit a step
        trial = np.clip(x[rows][:, None] + STEPS[:, None] * (d / long)[:, None], -bound, bound)
        values = f(trial.reshape(-1, k), np.repeat(rows, len(STEPS))).reshape(len(rows), -1)
        values = np.where(np.isfinite(values), values, np.inf)
        pick = values.argmin(1)
        best = values[np.arange(len(rows)), pick]
        better = best < value[rows] - 1e-13
        stuck = rows[~better]
        settled[stuck[plain[stuck]]] = True                             # steepest descent does not help either
        H[stuck], plain[stuck] = np.eye(k), True
        moved = rows[better]
        if not len(moved):
            continue
        new = trial[np.flatnonzero(better), pick[better]]
        settled[moved[value[moved] - best[better] < 1e-10]] = True      # per value of the series
        step, g_new = new - x[moved], gradient(new, moved)
        change = g_new - g[moved]
        sy = (step * change).sum(1)
        ok = sy > 1e-14
        r, s_, y_ = moved[ok], step[ok], change[ok]
        Hy = np.einsum("nij,nj->ni", H[r], y_)
        sy = sy[ok][:, None, None]
        yHy = (y_ * Hy).sum(1)[:, None, None]
        H[r] += ((1 + yHy / sy) * s_[:, :, None] * s_[:, None] - Hy[:, :, None] * s_[:, None] - s_[:, :, None] * Hy[:, None]) / sy
        plain[r] = False
        x[moved], g[moved], value[moved] = new, g_new, best[better]
    return x, settled


def fit(y: np.ndarray, orders: Orders, start: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Exact maximum likelihood of every row of ``y``: coefficients (to DIGITS), their standard errors,
    sigma2, log likelihood, AIC, values used, and whether the search settled.

    Starts from the best of ``start`` (coefficients; NaN: none) and a few points along the diagonal."""
    w = difference(orders, y)
    n, k = len(w), orders.n
    used = (~np.isnan(w)).sum(1)
    scale = np.sqrt(np.nanmean(np.where(np.isnan(w), 0.0, w * w), axis=1))[:, None]
    live = (scale[:, 0] > 0) & (used > k + 1)               # a series of zeros has no likelihood to speak of
    z = w / np.where(scale > 0, scale, 1.0)

    def badness(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        phi, theta = expand(orders, coefficients(orders, points))
        return -log_likelihood(z[rows], phi, theta)[0] / np.maximum(used[rows], 1)

    rows = np.flatnonzero(live)
    x = np.zeros((n, k))
    settled = np.zeros(n, bool)
    if k and len(rows):
        tries = [np.full((len(rows), k), v) for v in (np.arange(-9, 10) / 10 if k == 1 else np.arange(-6, 7, 3) / 10)]
        if start is not None:
            given = np.where(np.isfinite(start).all(1, keepdims=True), start, 0.0)
            tries.append(np.clip(partials(orders, given[rows]), -0.98, 0.98))
        values = np.array([badness(t, rows) for t in tries])
        first = np.array(tries)[values.argmin(0), np.arange(len(rows))]
        x[rows], settled[rows] = minimise(lambda p, r: badness(p, rows[r]), first)
    coefs = np.round(coefficients(orders, x), DIGITS)
    llf, sigma2 = log_likelihood(w, *expand(orders, coefs))
    se = np.full((n, k), np.nan)
    if k and len(rows):
        se[rows] = standard_errors(z[rows], orders, coefs[rows])
    blank = ~live
    llf, sigma2 = np.where(blank, np.nan, llf), np.where(blank, np.nan, sigma2)
    coefs = np.where(blank[:, None], np.nan, coefs)
    return {"coef": coefs, "se": se, "sigma2": sigma2, "llf": llf, "aic": 2.0 * (k + 1) - 2.0 * llf,
            "nobs": used, "settled": settled | (live & (k == 0))}


def standard_errors(w: np.ndarray, orders: Orders, coefs: np.ndarray, h: float = 1e-3) -> np.ndarray:
    """From the curvature of the log likelihood in the coefficients; NaN where it is not curved (edge of the box)."""
    n, k = coefs.shape
    unit = np.eye(k) * h
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    moves = np.array([si * unit[i] + sj * unit[j] for i, j in pairs for si, sj in ((1, 1), (1, -1), (-1, 1), (-1, -1))])
    points = (coefs[:, None] + moves).reshape(-1, k)
    inside = np.abs(partials(orders, points)).max(1) < BOUND
    points = np.where(inside[:, None], points, 0.0)
    llf = log_likelihood(np.repeat(w, len(moves), axis=0), *expand(orders, points))[0]
    llf = np.where(inside, llf, np.nan).reshape(n, len(pairs), 4)
    second = (llf[:, :, 0] - llf[:, :, 1] - llf[:, :, 2] + llf[:, :, 3]) / (4 * h * h)
    info = np.zeros((n, k, k))
    for at, (i, j) in enumerate(pairs):
        info[:, i, j] = info[:, j, i] = -second[:, at]
    out = np.full((n, k), np.nan)
    for r in range(n):
        if np.isfinite(info[r]).all() and np.linalg.cond(info[r]) < 1e12:
            var = np.diag(np.linalg.inv(info[r]))
            out[r] = np.sqrt(np.where(var > 0, var, np.nan))
    return out


def forecast(y: np.ndarray, orders: Orders, coefs: np.ndarray, horizon: int) -> np.ndarray:
    """The next ``horizon`` values of every row: the state runs on, the differences are undone."""
    phi, theta = expand(orders, np.nan_to_num(coefs))
    a = innovations(difference(orders, y), phi, theta)[3]
    poly = np.ones(1)
    for _ in range(orders.d):
        poly = np.convolve(poly, [1.0, -1.0])
    for _ in range(orders.D):
        poly = np.convolve(poly, np.r_[1.0, np.zeros(orders.s - 1), -1.0])
    lost = orders.lost
    past = np.hstack([y[:, y.shape[1] - lost:], np.zeros((len(y), horizon))])
    for t in range(horizon):
        past[:, lost + t] = a[:, 0] - past[:, t:lost + t] @ poly[:0:-1]
        a = _on(phi, a)
    return past[:, lost:]
