import datetime as dt

import numpy as np
import pytest

from brute import acf_biased, adfuller_c, pacf_yw
from kasaflow.functions.stats import adf_critical, adf_pvalue
from kasaflow.operators import diagnostics as D
from kasaflow.operators import series as S


def _frame(spark, named_series):
    base = dt.date(2020, 1, 1)
    rows = []
    for (branch, measure), xs in named_series.items():
        for i, v in enumerate(xs):
            rows.append((branch, measure, base + dt.timedelta(days=i), float(v)))
    return spark.createDataFrame(rows, "nazwa_kasy string, measure string, Data date, diff double")


@pytest.fixture(scope="module")
def fixture_series():
    rng = np.random.default_rng(7)
    return {
        ("B1", "white"): rng.normal(size=260),
        ("B1", "walk"): np.cumsum(rng.normal(size=240)),
        ("B2", "ar1"): np.array([0.0] + list(np.zeros(199))) + np.convolve(rng.normal(size=200), 0.6 ** np.arange(60))[:200],
        ("B2", "scaled"): 1e6 + 1e5 * rng.normal(size=150),
    }


def test_adf_matches_direct_least_squares(spark, fixture_series):
    out = {(r.nazwa_kasy, r.measure): r for r in D.adf_test(_frame(spark, fixture_series)).collect()}
    for key, xs in fixture_series.items():
        t, p, nobs = adfuller_c(xs)
        r = out[key]
        assert r.used_lag == p, key
        assert r.nobs == nobs, key
        assert r.adf_stat == pytest.approx(t, rel=1e-7, abs=1e-9), key
        assert r.p_value == pytest.approx(adf_pvalue(t), rel=1e-7)
        assert r.crit_5pct == pytest.approx(adf_critical(nobs)["5%"])
    assert out[("B1", "white")].stationary is True
    assert out[("B1", "walk")].stationary is False


def test_mackinnon_known_points():
    # 5 % and 1 % asymptotic points of the constant-only case
    assert adf_pvalue(-2.86) == pytest.approx(0.0502, abs=5e-4)
    assert adf_pvalue(-3.43) == pytest.approx(0.0100, abs=5e-4)
    assert adf_pvalue(5.0) == 1.0 and adf_pvalue(-30.0) == 0.0


def test_acf_and_pacf_match_numpy(spark, fixture_series):
    df = _frame(spark, fixture_series)
    acf_rows = S.acf(df, nlags=10)
    got = {}
    for r in acf_rows.collect():
        got.setdefault((r.nazwa_kasy, r.measure), {})[r.lag] = r.acf
    pac = {}
    for r in D.pacf(S.acf(df, nlags=10, digits=None)).collect():
        pac.setdefault((r.nazwa_kasy, r.measure), {})[r.lag] = r.pacf
    for key, xs in fixture_series.items():
        ref = acf_biased(xs, 10)
        assert [got[key][k] for k in range(11)] == pytest.approx(list(ref), abs=2e-9)
        refp = pacf_yw(xs, 10)
        assert [pac[key][k] for k in range(11)] == pytest.approx(list(refp), abs=1e-8)


def test_ljung_box_lag1(spark, fixture_series):
    df = _frame(spark, fixture_series).withColumnRenamed("diff", "resid")
    lb = {(r.nazwa_kasy, r.measure): r for r in D.with_ljung_box_pvalue(D.ljung_box(df)).collect()}
    import math
    for key, xs in fixture_series.items():
        n = len(xs)
        r1 = acf_biased(xs, 1)[1]
        q = n * (n + 2) * r1 * r1 / (n - 1)
        assert lb[key].lb_stat == pytest.approx(q, rel=1e-9)
        assert lb[key].lb_pvalue == pytest.approx(math.erfc(math.sqrt(q / 2)), rel=1e-9)
