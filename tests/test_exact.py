"""Exact likelihood and product structure against direct computations and simulations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kasaflow.functions import arma
from kasaflow.functions.arma import Orders
from kasaflow.operators import sarma
from kasaflow.operators.gram import ols_from_gram
from kasaflow.operators.lagreg import AR_LAGS, MA_LAGS
from kasaflow.operators.series import KEYS, series_diff, train_test_split

FULL_COEFS = np.array([[0.5, -0.3, 0.4, 0.2, 0.4, 0.1, -0.5]])


def autocovariance(phi, theta, n, k=6000):
    psi = np.zeros(k)
    psi[0] = 1
    for j in range(1, k):
        psi[j] = (theta[j - 1] if j <= len(theta) else 0) + sum(phi[i] * psi[j - 1 - i] for i in range(min(j, len(phi))))
    return np.array([psi[:k - h] @ psi[h:] for h in range(n)])


def direct(w, phi, theta):
    """Log density of the multivariate normal at its best scale, missing values left out."""
    here = ~np.isnan(w)
    S = autocovariance(phi, theta, len(w))[np.abs(np.subtract.outer(range(len(w)), range(len(w))))][np.ix_(here, here)]
    w = w[here]
    s2 = w @ np.linalg.solve(S, w) / len(w)
    return -0.5 * (len(w) * (np.log(2 * np.pi * s2) + 1) + np.linalg.slogdet(S)[1])


def simulate(orders, coefs, n, length, seed):
    phi, theta = (p[0] for p in arma.expand(orders, np.array([coefs])))
    e = np.random.default_rng(seed).normal(size=(n, length + 200))
    w = np.zeros_like(e)
    for t in range(30, e.shape[1]):
        w[:, t] = e[:, t] + sum(c * w[:, t - 1 - i] for i, c in enumerate(phi)) + sum(c * e[:, t - 1 - i] for i, c in enumerate(theta))
    return w[:, 200:]


def undifference(w, d, D, s):
    for _ in range(D):
        y = np.zeros((len(w), w.shape[1] + s))
        for t in range(w.shape[1]):
            y[:, s + t] = w[:, t] + y[:, t]
        w = y
    for _ in range(d):
        w = np.cumsum(np.hstack([np.zeros((len(w), 1)), w]), axis=1)
    return w


@pytest.mark.parametrize("orders,coefs", [
    (Orders(0, 0, 0, 0, 0, 1, 7), [-0.6]), (Orders(1, 0, 1), [0.7, 0.4]), (Orders(2, 0, 2, 2, 0, 1, 7), FULL_COEFS[0]),
    (Orders(0, 0, 1, 1, 0, 0, 4), [-0.9, 0.95])])
@pytest.mark.parametrize("holes", [[], [0, 5, 6, 17]])
def test_likelihood_is_that_of_the_multivariate_normal(orders, coefs, holes):
    coefs = np.array([coefs])
    phi, theta = arma.expand(orders, coefs)
    w = np.random.default_rng(1).normal(size=(3, 40))
    w[1:, holes] = np.nan  # the first series is complete
    got, _ = arma.log_likelihood(w, np.repeat(phi, 3, 0), np.repeat(theta, 3, 0))
    assert np.allclose(got, [direct(row, phi[0], theta[0]) for row in w], rtol=1e-9)
    alone, _ = arma.log_likelihood(w[:1], phi, theta)  # complete batch: the recursion without matrices
    assert np.allclose(alone, got[:1], rtol=1e-10)


def test_likelihood_of_differences_is_the_diffuse_likelihood_of_the_levels():
    orders, k = Orders(0, 1, 0, 0, 1, 1, 7), 1e7
    y = undifference(simulate(orders, [-0.6], 1, 30, 3), 1, 1, 7)[0] + 5.0
    lost = orders.lost
    # levels = start values (variance k) run on by the model + the differences' own noise
    run = np.zeros((len(y), lost))
    run[:lost] = np.eye(lost)
    for t in range(lost, len(y)):
        run[t] = run[t - 1] + run[t - 7] - run[t - 8]
    build = np.zeros((len(y), len(y) - lost))
    for t in range(lost, len(y)):
        build[t] = build[t - 1] + build[t - 7] - build[t - 8]
        build[t, t - lost] += 1
    phi, theta = arma.expand(orders, np.array([[-0.6]]))
    S = autocovariance(phi[0], theta[0], len(y) - lost)[np.abs(np.subtract.outer(range(len(y) - lost), range(len(y) - lost)))]
    w = arma.difference(orders, y[None])
    got, s2 = arma.log_likelihood(w, phi, theta)
    cov = s2[0] * (k * run @ run.T + build @ S @ build.T)
    whole = -0.5 * (len(y) * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + y @ np.linalg.solve(cov, y))
    start = -0.5 * (lost * np.log(2 * np.pi) + lost * np.log(s2[0] * k) + np.linalg.slogdet(run[:lost])[1] * 2)
    assert whole - start == pytest.approx(got[0], abs=1e-3)


def test_factors_and_partials_are_inverse_and_stationary():
    orders = Orders(2, 0, 2, 2, 0, 1, 7)
    r = np.random.default_rng(2).uniform(-0.95, 0.95, (50, orders.n))
    coefs = arma.coefficients(orders, r)
    assert np.allclose(arma.partials(orders, coefs), r)
    for phi, theta in zip(*arma.expand(orders, coefs)):
        assert np.abs(np.roots(np.r_[1, -phi])).max() < 1 and np.abs(np.roots(np.r_[1, theta])).max() < 1


def test_fit_recovers_simulated_coefficients_within_their_standard_errors():
    w = simulate(sarma.FULL, FULL_COEFS[0], 12, 1500, 4)
    got = arma.fit(w, sarma.FULL)
    assert got["settled"].all()
    z = (got["coef"] - FULL_COEFS) / got["se"]
    assert np.abs(z).mean() < 1.5 and np.abs(np.median(got["coef"], axis=0) - FULL_COEFS[0]).max() < 0.08
    truth, _ = arma.log_likelihood(w, *arma.expand(sarma.FULL, np.repeat(FULL_COEFS, 12, 0)))
    assert (got["llf"] >= truth).all() and np.allclose(got["sigma2"], 1, atol=0.12)


def test_seasonal_fit_and_forecast():
    orders = sarma.SEASONAL
    y = undifference(simulate(orders, [-0.6], 10, 800, 5), 1, 1, 7)
    got = arma.fit(y, orders)
    assert np.abs(got["coef"] + 0.6).max() < 0.12 and np.allclose(got["se"], np.sqrt((1 - 0.36) / 800), rtol=0.2)
    ahead = arma.forecast(y, orders, got["coef"], 10)
    more = np.hstack([y, ahead])
    w = arma.difference(orders, more)[:, -3:]
    assert np.allclose(w, 0, atol=1e-6)  # beyond one season the differences are expected to be 0


def test_forecast_is_the_conditional_mean_of_the_multivariate_normal():
    phi, theta = arma.expand(sarma.FULL, FULL_COEFS)
    w = simulate(sarma.FULL, FULL_COEFS[0], 1, 60, 6)
    g = autocovariance(phi[0], theta[0], 75)
    S = g[np.abs(np.subtract.outer(range(75), range(75)))]
    assert np.allclose(arma.forecast(w, sarma.FULL, FULL_COEFS, 15)[0], S[60:, :60] @ np.linalg.solve(S[:60, :60], w[0]))


def test_box_search_stops_at_the_edge_and_at_the_minimum():
    target = np.array([[0.2, 5.0], [-3.0, 0.4]])
    x, settled = arma.minimise(lambda p, rows: ((p - target[rows]) ** 2).sum(1) + 0.5 * p[:, 0] * p[:, 1], np.zeros((2, 2)), bound=0.9)
    assert settled.all() and np.allclose(x[:, [1, 0]].ravel()[[0, 3]], [0.9, -0.9])
    assert x[0, 0] == pytest.approx(0.2 - 0.25 * 0.9, abs=1e-5) and x[1, 1] == pytest.approx(0.4 + 0.25 * 0.9, abs=1e-5)


def test_gauss_newton_equals_a_search_over_the_rows():
    w = simulate(sarma.FULL, FULL_COEFS[0], 1, 3000, 7)[0]
    e = np.random.default_rng(8).normal(size=3000)
    X = np.array([[w[t], *[w[t - k] for k in AR_LAGS], *[e[t - k] for k in MA_LAGS], 1.0] for t in range(16, 3000)])
    G = X.T @ X
    x, ssr = sarma.gauss_newton(G, np.zeros(7))

    def rows(points, _):
        return np.array([((X[:, 0] - X[:, 1:14] @ b) ** 2).mean()
                         for b in sarma._lag_coefficients(sarma.FULL, arma.coefficients(sarma.FULL, points), AR_LAGS, MA_LAGS)])
    best, _ = arma.minimise(rows, x[None].copy())
    assert np.allclose(best[0], x, atol=2e-4) and ssr >= ols_from_gram(G, 0, list(range(1, 14)))[1]


# ---- over Spark --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def table(spark):
    n = 400
    y = undifference(simulate(sarma.SEASONAL, [-0.5], 3, n - 8, 9), 1, 1, 7)
    y = np.vstack([y, np.zeros(n), np.full(n, 7.0)])
    rows = [(f"b{k}", "m", t, None if k == 1 and t in (50, 51) else float(v)) for k, row in enumerate(y) for t, v in enumerate(row)]
    rows += [("short", "m", t, float(t)) for t in range(9)]
    df = spark.createDataFrame(rows, "nazwa_kasy string, measure string, t int, value double")
    return train_test_split(series_diff(df.select(*KEYS, F.date_add(F.lit("2020-01-01").cast("date"), "t").alias("Data"), "value")))


def test_exact_fit_over_series_with_gaps_constants_and_few_values(spark, table):
    fit = sarma.exact_fit(table, sarma.SEASONAL, "value")
    got = {r.nazwa_kasy: r for r in fit.collect()}
    assert len(got) == 6
    for name in ("b3", "b4", "short"):
        assert got[name].coef is None and got[name].pred is None and (got[name].llf is None or np.isnan(got[name].llf))
    train = {b: np.array([r.value if r.value is not None else np.nan for r in table.where(f"nazwa_kasy = '{b}' AND split = 'train'")
                          .orderBy("rn").collect()], float) for b in ("b0", "b1", "b2")}
    for b, y in train.items():
        alone = arma.fit(y[None], sarma.SEASONAL)
        assert got[b].coef == pytest.approx(alone["coef"][0].tolist(), abs=2e-4) and len(got[b].pred) == 40
        assert got[b].llf == pytest.approx(alone["llf"][0], rel=1e-6)
        phi, theta = (p[0] for p in arma.expand(sarma.SEASONAL, np.array([got[b].coef])))
        w = arma.difference(sarma.SEASONAL, y[None])[0]
        assert got[b].llf == pytest.approx(direct(w, phi, theta), rel=1e-8)


def test_exact_forecast_frames(spark, table):
    levels = sarma.exact_fit(table, sarma.SEASONAL, "value")
    fc = sarma.exact_forecast(table, levels, "value").where("nazwa_kasy = 'b0'").orderBy("h").collect()
    assert [r.h for r in fc] == list(range(1, 41))
    back = np.cumsum([r.pred_diff for r in fc]) + fc[0].y_T
    assert np.allclose(back, [r.pred_level for r in fc])
    steps = sarma.exact_fit(table, Orders(1, 0, 1), "diff")
    fc = sarma.exact_forecast(table, steps, "diff").where("nazwa_kasy = 'b0'").orderBy("h").collect()
    assert np.allclose(np.cumsum([r.pred_diff for r in fc]) + fc[0].y_T, [r.pred_level for r in fc])


def test_factors_of_every_series_and_their_residual_sums(spark):
    from kasaflow.plans.catalog import queries
    rows = queries()["sarma_factors"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 30 * 7 and {r.name for r in rows} == set(sarma.FULL.names())
    by_series = {}
    for r in rows:
        by_series.setdefault((r.nazwa_kasy, r.measure), {})[r.name] = r.coef
        assert r.ssr >= r.free_ssr * (1 - 1e-9)
    for coefs in by_series.values():
        phi, theta = arma.expand(sarma.FULL, np.array([[coefs[n] for n in sarma.FULL.names()]]))
        assert np.abs(np.roots(np.r_[1, -phi[0]])).max() < 1 and np.abs(np.roots(np.r_[1, theta[0]])).max() < 1


# ---- order search with refit -----------------------------------------------------------------------

def test_seasonal_root_regression():
    rng = np.random.default_rng(10)
    assert sarma.root_point(12) == pytest.approx(-1.803, abs=2e-3)  # the published curve at monthly data
    noise = [sarma.seasonal_root(rng.normal(size=400)) for _ in range(100)]
    walks = [sarma.seasonal_root(undifference(rng.normal(size=(1, 400)), 0, 1, 7)[0]) for _ in range(100)]
    assert np.mean(np.array(noise) < sarma.root_point()) == 1.0
    assert np.mean(np.array(walks) > sarma.root_point()) > 0.9
    x = rng.normal(size=300)
    d1, ds = np.diff(x), x[7:] - x[:-7]
    w = np.diff(ds)
    X = np.array([[w[i - 1], w[i - 2], w[i - 3], ds[i], d1[i]] for i in range(3, len(w))])
    beta, ssr = np.linalg.lstsq(X, w[3:], rcond=None)[:2]
    se = np.sqrt(ssr[0] / (len(X) - 5) * np.linalg.inv(X.T @ X)[4, 4])
    assert sarma.seasonal_root(x) == pytest.approx(beta[4] / se)
    x[5] = np.nan
    assert np.isfinite(sarma.seasonal_root(x)) and np.isnan(sarma.seasonal_root(x[:20]))


def test_neighbours_stay_within_the_limits():
    assert set(sarma.neighbours((0, 0, 0, 0))) == {(1, 0, 0, 0), (0, 1, 0, 0), (1, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (0, 0, 1, 1)}
    assert all(sum(o) <= 5 and o != (3, 2, 0, 0) for o in sarma.neighbours((3, 2, 0, 0)))


def test_order_search_finds_planted_orders(spark):
    planted = {"ar": (Orders(1, 0, 0), [0.7]), "ma": (Orders(0, 0, 1), [0.6]), "sma": (Orders(0, 0, 0, 0, 0, 1, 7), [-0.6]),
               "sar": (Orders(1, 0, 0, 1, 0, 0, 7), [0.3, 0.4]),
               "noise": (Orders(0, 0, 0), [])}
    n, rows = 900, []
    for k, (name, (orders, coefs)) in enumerate(planted.items()):
        x = simulate(orders, coefs, 1, n, 20 + k)[0] if coefs else np.random.default_rng(30).normal(size=n)
        rows += [(name, "m", t, float(v)) for t, v in enumerate(np.cumsum(x))]
    walk = undifference(np.random.default_rng(40).normal(size=(1, n)), 0, 1, 7)[0]
    rows += [("weekroot", "m", t, float(v)) for t, v in enumerate(np.cumsum(walk))]
    rows += [("gaps", "m", t, None if t % 211 == 5 else float(v)) for t, v in enumerate(np.cumsum(simulate(*planted["ma"], 1, n, 51)[0]))]
    rows += [("flat", "m", t, 1.0) for t in range(n)] + [("short", "m", t, float(t % 3)) for t in range(20)]
    df = spark.createDataFrame(rows, "nazwa_kasy string, measure string, t int, value double")
    split = train_test_split(series_diff(df.select(*KEYS, F.date_add(F.lit("2020-01-01").cast("date"), "t").alias("Data"), "value")))
    got = {r.nazwa_kasy: r for r in sarma.order_search_refit(split).collect()}
    assert set(got) == {*planted, "weekroot", "gaps"}
    for name, (orders, coefs) in planted.items():
        r = got[name]
        assert r.sd == 0 and 4 <= r.n_tried <= 96, name
        if name == "sar" and r.d:  # the KPSS window is shorter than a week, so it takes this one for a unit root
            continue
        assert r.d == 0, name
        z = np.array([v.x for v in _train(split, name)])
        own = arma.fit(z[None], orders)["aic"][0]
        assert r.aic <= own + 4, name        # as good as the planted orders
        assert r.p >= orders.p or r.q > 0, name
    assert got["ar"].p >= 1 and got["sma"].sq + got["sma"].sp >= 1 and got["sar"].sp >= 1
    assert got["weekroot"].sd == 1
    gaps = np.array([np.nan if v.x is None else v.x for v in _train(split, "gaps")])
    assert got["gaps"].nobs == (~np.isnan(gaps)).sum() < got["ma"].nobs and got["gaps"].d == 0
    assert got["gaps"].aic <= arma.fit(gaps[None], planted["ma"][0])["aic"][0] + 4


def _train(split, name):
    from kasaflow.operators.series import train_series
    return train_series(split).where(F.col("nazwa_kasy") == name).select("rn", F.col("diff").alias("x")).orderBy("rn").collect()


def test_missing_values_are_left_out_of_the_gram_matrix(spark):
    from kasaflow.operators.gram import gram_rows, matrix_from_rows
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", None, 5.0), ("a", 3.0, 1.0)], "k string, x double, y double")
    rows = gram_rows(df, ["k"], ["x", "y"]).collect()
    assert matrix_from_rows([r.i for r in rows], [r.g for r in rows]).tolist() == [[10.0, 5.0], [5.0, 5.0]]
