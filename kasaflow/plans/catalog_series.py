"""Time-series queries (registered into the same catalogue)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kasaflow.operators import series as S
from kasaflow.plans.catalog import lower, register
from kasaflow.plans.workspace import workspace


def long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = workspace(spark, sf_dir)
    lo, hi = ws.span
    return S.series_long(ws.fact, lo, hi)


def split_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derivation, planned from the fact (used by the series queries themselves)."""
    return S.train_test_split(S.series_diff(long_series(spark, sf_dir)))


def series_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, materialised once in the workspace (used downstream)."""
    return workspace(spark, sf_dir).series


@register("series_long")
def q_series_long(spark, sf_dir):
    return lower(long_series(spark, sf_dir))


@register("series_diff")
def q_series_diff(spark, sf_dir):
    return lower(S.series_diff(long_series(spark, sf_dir)))


@register("train_test_split")
def q_train_test_split(spark, sf_dir):
    return lower(split_series(spark, sf_dir).select(*S.KEYS, "Data", "value", "diff", "rn", "n",
                                                    "n_test", "split"))


@register("last_train_value")
def q_last_train_value(spark, sf_dir):
    return lower(S.last_train_value(series_table(spark, sf_dir)))


@register("train_series")
def q_train_series(spark, sf_dir):
    return lower(S.train_series(series_table(spark, sf_dir)).select(*S.KEYS, "Data", "value", "diff"))


@register("null_counts")
def q_null_counts(spark, sf_dir):
    return lower(S.null_counts(S.train_series(series_table(spark, sf_dir))))


@register("undiff_actual")
def q_undiff_actual(spark, sf_dir):
    return lower(S.undiff_actual(series_table(spark, sf_dir)))


@register("diff_histogram")
def q_diff_histogram(spark, sf_dir):
    return lower(S.diff_histogram(series_table(spark, sf_dir)))


@register("measure_correlation")
def q_measure_correlation(spark, sf_dir):
    return lower(S.measure_correlation(workspace(spark, sf_dir).fact))


@register("acf")
def q_acf(spark, sf_dir):
    return lower(S.acf(series_table(spark, sf_dir)))


# ------------------------------------------------------------ diagnostics ---

from kasaflow.operators import diagnostics as D  # noqa: E402


@register("adf_gram")
def q_adf_gram(spark, sf_dir):
    """Common-sample Gram matrix of each series' ADF design: the (L+3)^2 block
    of (dx, x_lag, 1, dx lags 1..L) on standardised x."""
    g = D.adf_gram(series_table(spark, sf_dir))
    out = (g.select(*S.KEYS, "n", "L", "i", F.posexplode("g").alias("j", "g"))
           .filter((F.col("i") <= F.col("L") + 2) & (F.col("j") <= F.col("L") + 2)))
    return lower(out.select(*S.KEYS, F.col("n").cast("long").alias("n"), F.col("L").cast("int").alias("L"),
                            F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"),
                            (F.round("g", 4) + F.lit(0.0)).alias("g")))


@register("adf_test")
def q_adf_test(spark, sf_dir):
    t = D.with_verdict(D.adf_test(series_table(spark, sf_dir)))
    rounded = {c: F.round(c, 6) for c in ("adf_stat", "p_value", "crit_1pct", "crit_5pct", "crit_10pct")}
    return lower(t.withColumns(rounded))


@register("pacf")
def q_pacf(spark, sf_dir):
    return lower(D.pacf(S.acf(series_table(spark, sf_dir), digits=None)))


@register("acf_bounds")
def q_acf_bounds(spark, sf_dir):
    return lower(D.acf_bounds(S.acf(series_table(spark, sf_dir), digits=None)))


@register("pacf_bounds")
def q_pacf_bounds(spark, sf_dir):
    return lower(D.pacf_bounds(S.acf(series_table(spark, sf_dir), digits=None)))


# --------------------------------------------------------------- forecast ---

from kasaflow.operators import forecast as FC  # noqa: E402

SEASONAL_MA = "sarima_010_011_7"


def seasonal_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir).seasonal_forecast


@register("forecast_seasonal_ma")
def q_forecast_seasonal_ma(spark, sf_dir):
    fc = seasonal_forecast(spark, sf_dir)
    return lower(fc.select(*S.KEYS, "Data", "h", "theta", F.round("pred_diff", 6).alias("pred_diff"),
                           F.round("pred_level", 2).alias("pred_level")))


@register("undiff_forecast")
def q_undiff_forecast(spark, sf_dir):
    fc = seasonal_forecast(spark, sf_dir)
    return lower(fc.select(*S.KEYS, "Data", "h", F.round("pred_level", 2).alias("level")))


@register("forecast_metrics")
def q_forecast_metrics(spark, sf_dir):
    return lower(FC.forecast_metrics(seasonal_forecast(spark, sf_dir), SEASONAL_MA))


@register("ljung_box")
def q_ljung_box(spark, sf_dir):
    lb = D.ljung_box(FC.residuals(seasonal_forecast(spark, sf_dir)))
    return lower(lb.select(*S.KEYS, "n", "lags", F.round("lb_stat", 6).alias("lb_stat")))


@register("ljung_box_pvalue")
def q_ljung_box_pvalue(spark, sf_dir):
    lb = D.with_ljung_box_pvalue(D.ljung_box(FC.residuals(seasonal_forecast(spark, sf_dir))))
    return lower(lb.select(*S.KEYS, "n", "lags", F.round("lb_stat", 6).alias("lb_stat"),
                           F.round("lb_pvalue", 9).alias("lb_pvalue")))


@register("forecast_compare")
def q_forecast_compare(spark, sf_dir):
    return lower(FC.forecast_compare(seasonal_forecast(spark, sf_dir)))


@register("forecast_mean_ratio")
def q_forecast_mean_ratio(spark, sf_dir):
    out = FC.mean_ratio(FC.forecast_compare(seasonal_forecast(spark, sf_dir)))
    return lower(out.select(*S.KEYS, F.round("srednia_roznica", 6).alias("srednia_roznica")))


# ------------------------------------------------ lag regression, order search ---

from kasaflow.operators import lagreg as LR  # noqa: E402

LAG_REGRESSION = "sarima_202_201_7_hr"


def lag_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace(spark, sf_dir).lag_forecast


def seven_digits(*columns: str):
    """Columns to single precision (about 7 significant digits): the fit is good to about 11, and a
    forecast of unstable coefficients grows without bound, so decimals would not say what holds."""
    return [F.col(f"`{c}`").cast("float").cast("double").alias(c) for c in columns]


@register("forecast_lag_regression")
def q_forecast_lag_regression(spark, sf_dir):
    return lower(lag_forecast(spark, sf_dir).select(*S.KEYS, "Data", "h", *seven_digits("pred_diff", "pred_level")))


@register("forecast_lag_regression_metrics")
def q_forecast_lag_regression_metrics(spark, sf_dir):
    m = FC.forecast_metrics(lag_forecast(spark, sf_dir), LAG_REGRESSION)
    return lower(m.select(*S.KEYS, "n", *seven_digits("rmse", "mae", "r2"), "model"))


# The notebook un-differences, compares and tests its second fit; these follow it.

@register("ljung_box_lag_regression")
def q_ljung_box_lag_regression(spark, sf_dir):
    lb = D.with_ljung_box_pvalue(D.ljung_box(FC.residuals(lag_forecast(spark, sf_dir))))
    return lower(lb.select(*S.KEYS, "n", "lags", F.round("lb_stat", 6).alias("lb_stat"),
                           F.round("lb_pvalue", 9).alias("lb_pvalue")))


@register("undiff_forecast_lag_regression")
def q_undiff_forecast_lag_regression(spark, sf_dir):
    return lower(lag_forecast(spark, sf_dir).select(*S.KEYS, "Data", "h", *seven_digits("pred_level"))
                 .withColumnRenamed("pred_level", "level"))


@register("forecast_compare_lag_regression")
def q_forecast_compare_lag_regression(spark, sf_dir):
    c = FC.forecast_compare(lag_forecast(spark, sf_dir))
    return lower(c.select(*S.KEYS, "Data", "h", "dane_oryg", *seven_digits("dane_pred", "roznica", "roznica_%")))


@register("forecast_mean_ratio_lag_regression")
def q_forecast_mean_ratio_lag_regression(spark, sf_dir):
    out = FC.mean_ratio(FC.forecast_compare(lag_forecast(spark, sf_dir)))
    return lower(out.select(*S.KEYS, F.round("srednia_roznica", 6).alias("srednia_roznica")))


@register("order_search")
def q_order_search(spark, sf_dir):
    """Chosen orders of every series; their terms as text."""
    found = workspace(spark, sf_dir).order_search
    return lower(found.select(*S.KEYS, "p", "d", "q", "sp", "sd", "sq", "s", F.round("aic", 4).alias("aic"), "n_params", "n_candidates",
                              F.array_join("terms", ",").alias("terms")))


@register("order_search_terms")
def q_order_search_terms(spark, sf_dir):
    """One row a term of the chosen orders, with its coefficient."""
    found = workspace(spark, sf_dir).order_search
    terms = found.select(*S.KEYS, F.explode(F.arrays_zip(F.col("terms").alias("term"), "coef")).alias("t"))
    return lower(terms.select(*S.KEYS, F.col("t.term").alias("term"), F.round("t.coef", 5).alias("coef")))


# ------------------------------------------------ exact likelihood ---

from kasaflow.operators import sarma as SA  # noqa: E402

EXACT = {"sarima_010_011_7_exact": ("exact_seasonal", SA.SEASONAL, "value"),
         "sarima_202_201_7_exact": ("exact_full", SA.FULL, "diff")}


def exact_forecast(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    ws = workspace(spark, sf_dir)
    stage, _, x = EXACT[model]
    return SA.exact_forecast(ws.series, getattr(ws, stage), x)


@register("sarma_factors")
def q_sarma_factors(spark, sf_dir):
    """Factors of the (2,0,2)(2,0,1,7) model by Gauss-Newton on the Gram rows."""
    return lower(SA.factor_table(workspace(spark, sf_dir).factors))


@register("exact_fit_seasonal")
def q_exact_fit_seasonal(spark, sf_dir):
    fit = SA.exact_summary(workspace(spark, sf_dir).exact_seasonal, SA.SEASONAL)
    return lower(fit.select(*S.KEYS, F.round("coef", 3).alias("theta"), F.round("llf", 2).alias("llf"),
                            F.round("aic", 2).alias("aic"), "nobs"))


@register("exact_fit_full")
def q_exact_fit_full(spark, sf_dir):
    return lower(SA.exact_summary(workspace(spark, sf_dir).exact_full, SA.FULL))


@register("forecast_exact_seasonal")
def q_forecast_exact_seasonal(spark, sf_dir):
    fc = exact_forecast(spark, sf_dir, "sarima_010_011_7_exact")
    return lower(fc.select(*S.KEYS, "Data", "h", F.round("pred_diff", 2).alias("pred_diff"), F.round("pred_level", 2).alias("pred_level")))


@register("forecast_exact_full")
def q_forecast_exact_full(spark, sf_dir):
    fc = exact_forecast(spark, sf_dir, "sarima_202_201_7_exact")
    return lower(fc.select(*S.KEYS, "Data", "h", "pred_diff", "pred_level"))


@register("forecast_exact_seasonal_metrics")
def q_forecast_exact_seasonal_metrics(spark, sf_dir):
    model = "sarima_010_011_7_exact"
    return lower(FC.forecast_metrics(exact_forecast(spark, sf_dir, model), model, digits=4))


@register("forecast_exact_full_metrics")
def q_forecast_exact_full_metrics(spark, sf_dir):
    """RMSE, MAE and R2 of the exact (2,0,2)(2,0,1,7) fit, with the Ljung-Box test of its errors."""
    model = "sarima_202_201_7_exact"
    fc = exact_forecast(spark, sf_dir, model)
    lb = D.with_ljung_box_pvalue(D.ljung_box(FC.residuals(fc))).select(*S.KEYS, "lb_stat", "lb_pvalue")
    return lower(FC.forecast_metrics(fc, model).join(lb, S.KEYS))


@register("order_search_refit")
def q_order_search_refit(spark, sf_dir):
    """Orders by a stepwise search that fits each candidate anew; exact likelihood of the chosen one."""
    found = workspace(spark, sf_dir).order_refit
    return lower(found.select(*S.KEYS, "p", "d", "q", "sp", "sd", "sq", "s", "aic", "llf", "sigma2", "nobs", "n_tried",
                              F.array_join("names", ",").alias("terms")))
