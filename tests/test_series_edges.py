"""FIXTURES edge cases: split sizes, round trips, constant and short series,
comparison and formatting examples."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kasaflow.functions.formatting import money_text, whole_text
from kasaflow.operators import diagnostics as D
from kasaflow.operators import forecast as FC
from kasaflow.operators import series as S


def _series(spark, named):
    base = dt.date(2022, 1, 1)
    rows = [(b, m, base + dt.timedelta(days=i), float(v)) for (b, m), ys in named.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "nazwa_kasy string, measure string, Data date, value double")


def test_split_sizes_follow_ceil_of_tenth(spark):
    named = {("B", f"n{n}"): list(range(n)) for n in (10, 11, 19, 30)}
    split = S.train_test_split(S.series_diff(_series(spark, named)))
    got = {r.measure: r.n_test for r in split.select("measure", "n_test").distinct().collect()}
    assert got == {"n10": 1, "n11": 2, "n19": 2, "n30": 3}
    tests = split.filter("split = 'test'").groupBy("measure").count().collect()
    assert {r.measure: r["count"] for r in tests} == got


def test_first_difference_zero_and_round_trip(spark):
    rng = np.random.default_rng(3)
    ys = np.round(rng.normal(1000, 50, size=60), 2)
    split = S.train_test_split(S.series_diff(_series(spark, {("B", "m"): ys})))
    train = S.train_series(split).orderBy("Data").collect()
    assert train[0].diff == 0.0 and all(r.diff is not None for r in train)
    back = S.undiff_actual(split).orderBy("Data").collect()
    assert [r.level for r in back] == pytest.approx([round(v, 2) for v in ys[-len(back):]], abs=1e-9)
    nulls = S.null_counts(S.train_series(split)).collect()[0]
    assert (nulls.null_data, nulls.null_value, nulls.null_diff) == (0, 0, 0)


def test_histogram_counts_sum_to_n_and_constant_series(spark):
    rng = np.random.default_rng(5)
    named = {("B", "noise"): rng.normal(size=200), ("B", "const"): np.full(50, 7.0)}
    d = S.series_diff(_series(spark, named))
    h = S.diff_histogram(d).collect()
    assert sum(r.n for r in h if r.measure == "noise") == 199
    assert sorted((r.bin, r.n) for r in h if r.measure == "const") == [(0, 49)] + [(k, 0) for k in range(1, 20)]
    assert sorted(r.bin for r in h if r.measure == "noise") == list(range(20))  # empty bins too


def test_null_amount_stays_null_and_missing_day_is_zero(spark):
    rows = [("B", dt.date(2022, 1, 1), 5.0), ("B", dt.date(2022, 1, 2), None), ("B", dt.date(2022, 1, 4), 7.0)]
    fact = spark.createDataFrame(rows, "nazwa_kasy string, Data date, nad_kz double")
    long = S.series_long(fact, "2022-01-01", "2022-01-04", ["nad_kz"])
    assert [r.value for r in long.orderBy("Data").collect()] == [5.0, None, 0.0, 7.0]
    counts = S.null_counts(S.series_diff(long)).collect()[0]
    assert (counts.n_rows, counts.null_value, counts.null_diff) == (4, 1, 3)


def test_chi_square_tail_for_any_lags():
    from kasaflow.functions.stats import chi2_sf
    q = np.array([0.0, 0.5, 3.84, 20.0, 60.0])
    assert chi2_sf(q, np.ones(5)) == pytest.approx([math.erfc(math.sqrt(v / 2)) for v in q], rel=1e-9)
    assert chi2_sf(q, np.full(5, 4.0)) == pytest.approx([math.exp(-v / 2) * (1 + v / 2) for v in q], rel=1e-9)


def test_cents_are_exact_and_rounded_like_decimals(spark):
    from kasaflow.functions.amounts import cents_sum, exact_sum
    df = spark.createDataFrame([(0.1,)] * 1000 + [(9_000_000_000_000.07,)] * 20, "x double")
    assert df.select(cents_sum("x")).first()[0] == 1000 * 10 + 20 * 900_000_000_000_007
    assert df.where("x < 1").select(exact_sum("x")).first()[0] == 100.0
    odd = spark.createDataFrame([(0.125,), (-0.125,)], "x double")
    assert [r[0] for r in odd.select(cents_sum("x")).union(odd.where("x > 0").select(cents_sum("x"))).collect()] == [0, 13]


def test_constant_and_short_series_do_not_fail(spark):
    named = {("B", "const"): np.full(40, 3.0), ("B", "short"): np.arange(20, dtype=float) ** 1.5}
    d = S.series_diff(_series(spark, named))
    acf = {(r.measure, r.lag): r.acf for r in S.acf(d, nlags=30).collect()}
    assert acf[("const", 0)] is None                       # zero variance -> NULL, not an error
    adf = {r.measure: r for r in D.adf_test(d).collect()}
    assert adf["const"].used_lag is None or math.isnan(adf["const"].adf_stat)
    assert adf["short"].nobs is not None                   # short series still tested (maxlag capped)
    split = S.train_test_split(d)
    assert FC.seasonal_ma_forecast(split).count() == 4 + 2  # ceil(0.1*40) + ceil(0.1*20)


def test_compare_example_and_zero_actual(spark):
    rows = [("B", "m", dt.date(2022, 1, 2), 1, 200.0, 50.0, 150.0, 0.0, 75.0, 225.0),
            ("B", "m", dt.date(2022, 1, 3), 2, 0.0, -200.0, 150.0, 0.0, 0.0, 225.0)]
    fc = spark.createDataFrame(rows, "nazwa_kasy string, measure string, Data date, h long, value double, "
                                     "diff double, y_T double, theta double, pred_diff double, pred_level double")
    out = {r.h: r for r in FC.forecast_compare(fc).collect()}
    # actual 200 rebuilt from 150 + 50; prediction 150 + 75 = 225
    assert (out[1].dane_oryg, out[1].dane_pred, out[1].roznica) == (200.0, 225.0, -25.0)
    assert out[1]["roznica_%"] == 112.5
    assert out[2].dane_oryg == 0.0 and out[2]["roznica_%"] is None


def test_formatting_parity(spark):
    df = spark.createDataFrame([(1234567.891,), (None,), (1234567.5,), (16777217.0,)], "x double")
    got = df.select(money_text(F.col("x")).alias("m"), whole_text(F.col("x")).alias("w")).collect()
    assert got[0].m == "1,234,567.89" and got[1].m is None
    assert got[2].w == "1,234,568" and got[1].w == "" and got[3].w == "16,777,216"
