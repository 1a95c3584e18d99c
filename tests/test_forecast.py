import datetime as dt

import numpy as np
import pytest

from brute import seasonal_ma_forecast, seasonal_ma_refined
from kasaflow.operators import forecast as FC
from kasaflow.operators import series as S


def _series(spark, named):
    base = dt.date(2021, 3, 1)
    rows = [(b, m, base + dt.timedelta(days=i), float(v)) for (b, m), ys in named.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "nazwa_kasy string, measure string, Data date, value double")


def _sim(rng, n, theta):
    e = rng.normal(size=n + 8)
    w = e[7:] + theta * e[:-7]
    v = np.zeros(n)
    for t in range(n):
        v[t] = w[t] + (v[t - 7] if t >= 7 else 0.0)
    return 100 + np.cumsum(v)


@pytest.fixture(scope="module")
def sims():
    rng = np.random.default_rng(11)
    return {("B", "ma06"): _sim(rng, 700, -0.6), ("B", "ma03"): _sim(rng, 500, 0.3),
            ("C", "short"): _sim(rng, 40, -0.2), ("C", "ma098"): _sim(rng, 2800, -0.98)}


def test_seasonal_ma_matches_direct_recursion(spark, sims):
    split = S.train_test_split(S.series_diff(_series(spark, sims)))
    fc = FC.seasonal_ma_forecast(split).collect()
    by = {}
    for r in fc:
        by.setdefault((r.nazwa_kasy, r.measure), []).append(r)
    for key, ys in sims.items():
        n = len(ys)
        n_test = int(np.ceil(0.1 * n))
        train = ys[: n - n_test]
        th, sse, e = seasonal_ma_refined(train)
        ref = seasonal_ma_forecast(train, th, e, n_test)
        rows = sorted(by[key], key=lambda r: r.h)
        assert len(rows) == n_test
        assert rows[0].theta == pytest.approx(th)
        for r, (vd, lvl) in zip(rows, ref):
            assert r.pred_diff == pytest.approx(vd, rel=1e-9, abs=1e-9)
            assert r.pred_level == pytest.approx(lvl, rel=1e-9)


def test_theta_recovered(spark, sims):
    split = S.train_test_split(S.series_diff(_series(spark, sims)))
    fit = FC.seasonal_ma_fit(split)
    got = {(r.nazwa_kasy, r.measure): r.theta for r in fit.collect()}
    assert abs(got[("B", "ma06")] + 0.6) <= 0.1
    assert abs(got[("B", "ma03")] - 0.3) <= 0.1
    assert abs(got[("C", "ma098")] + 0.98) <= 0.012   # beyond the coarse grid's end


def test_missing_value_leaves_its_chain_alone():
    w = np.array([[1.0, 2.0], [np.nan, 1.0], [3.0, np.nan]])
    e, sse = FC._fold(w, np.array([0.0, 0.5]))
    assert e.tolist() == [[3.0, 2.5], [1.0, 0.0]]
    assert sse.tolist() == [1 + 9 + 4 + 1, 1 + 2.5 ** 2 + 4 + 0]


def test_compare_and_metrics(spark, sims):
    split = S.train_test_split(S.series_diff(_series(spark, sims)))
    fc = FC.seasonal_ma_forecast(split, fixed_theta=0.0)
    cmp_rows = FC.forecast_compare(fc).collect()
    for r in cmp_rows:
        assert r.roznica == pytest.approx(round(r.dane_oryg - r.dane_pred, 2), abs=0.011)
    m = {(r.nazwa_kasy, r.measure): r for r in FC.forecast_metrics(fc).collect()}
    for key, ys in sims.items():
        n = len(ys)
        n_test = int(np.ceil(0.1 * n))
        rows = sorted([r for r in fc.collect() if (r.nazwa_kasy, r.measure) == key], key=lambda r: r.h)
        res = np.array([r.diff - r.pred_diff for r in rows])
        d = np.array([r.diff for r in rows])
        assert m[key].rmse == pytest.approx(np.sqrt(np.mean(res ** 2)), rel=1e-6)
        assert m[key].mae == pytest.approx(np.mean(np.abs(res)), rel=1e-6)
        assert m[key].r2 == pytest.approx(1 - (res ** 2).sum() / ((d - d.mean()) ** 2).sum(), rel=1e-6, abs=1e-6)


def test_lag_regression_matches_direct_two_stage(spark, sims):
    from brute import hannan_rissanen
    from kasaflow.operators import lagreg as LR
    split = S.train_test_split(S.series_diff(_series(spark, {k: v for k, v in sims.items() if len(v) > 100})))
    fc = LR.lag_regression_forecast(split).collect()
    for key in [("B", "ma06"), ("B", "ma03")]:
        ys = sims[key]
        n = len(ys)
        n_test = int(np.ceil(0.1 * n))
        x = np.diff(ys[: n - n_test], prepend=np.nan)
        x[0] = 0.0
        _, ref = hannan_rissanen(x, LR.AR_LAGS, LR.MA_LAGS, LR.LONG_AR, n_test)
        rows = sorted([r for r in fc if (r.nazwa_kasy, r.measure) == key], key=lambda r: r.h)
        assert [r.pred_diff for r in rows] == pytest.approx(ref, rel=1e-6, abs=1e-8)


def test_order_search_prefers_true_seasonal_ma(spark, sims):
    from kasaflow.operators import lagreg as LR
    split = S.train_test_split(S.series_diff(_series(spark, {("B", "ma06"): sims[("B", "ma06")]})))
    r = LR.order_search(split).collect()[0]
    assert r.n_candidates == len(LR.candidate_orders()) == 96
    assert r.sd == 1 or r.sp + r.sq >= 1  # the weekly pattern is picked up
    assert len(r.terms) == len(r.coef) == r.n_params


def test_order_search_differencing(spark):
    from kasaflow.operators import lagreg as LR
    rng = np.random.default_rng(4)
    week = np.tile([0, 5, 9, 3, -4, -7, -6], 90).astype(float)
    named = {("B", "noise"): np.cumsum(rng.normal(size=630)), ("B", "walk"): np.cumsum(np.cumsum(rng.normal(size=630))),
             ("B", "weekly"): np.cumsum(week + rng.normal(size=630) * 0.5)}
    split = S.train_test_split(S.series_diff(_series(spark, named)))
    got = {r.measure: (r.d, r.sd) for r in LR.order_search(split).collect()}
    assert got["noise"] == (0, 0)       # its differences are white noise
    assert got["walk"][0] == 1          # its differences are a random walk
    assert got["weekly"][1] == 1        # a strong weekly pattern


def test_kpss_and_strength_on_known_cases():
    from kasaflow.operators import lagreg as LR
    rng = np.random.default_rng(1)
    rejected = np.mean([LR.kpss_level(rng.normal(size=400)) > LR.KPSS_5PCT for _ in range(1000)])
    assert 0.03 < rejected < 0.07  # the 5 % point
    x = rng.normal(size=500)
    assert LR.KPSS_5PCT < LR.kpss_level(np.cumsum(x))
    assert LR.seasonal_strength(x) < 0.3 < 0.9 < LR.seasonal_strength(x + 8 * np.tile(np.arange(7), 72)[:500])
    assert LR.kpss_level(np.zeros(50)) == 0.0 and LR.seasonal_strength(np.zeros(50)) == 0.0
