"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the test tables through the workspace (fact derived from
``lineitem`` et al.), so its work grows with the data. Output columns are
lower case, matching the DuckDB oracle in ``kasaflow.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kasaflow.functions.constants import MEASURES
from kasaflow.functions.dates import month_starts
from kasaflow.operators import deadlines, enrich, reports
from kasaflow.plans import params as P
from kasaflow.plans.workspace import workspace
from kasaflow.session import ship_package
from kasaflow.plans.publish import publish, published
from kasaflow.sources.csv_source import bad_counts, bad_rows, read_cash_csv, scan_cash_csv

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        _REGISTRY[name] = run
        return fn
    return deco


def lower(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def queries() -> dict[str, Query]:
    # Import for the side effect of registering the series/forecast queries.
    from kasaflow.plans import catalog_series  # noqa: F401
    return dict(_REGISTRY)


# ---------------------------------------------------------------- sources ---

@register("csv_scan")
def q_csv_scan(spark, sf_dir):
    """The fact as a ';' CSV with a header in the shared folder (written once), read back."""
    return lower(read_cash_csv(spark, workspace(spark, sf_dir).csv_path))


@register("csv_scan_inferred")
def q_csv_scan_inferred(spark, sf_dir):
    """The same file read the notebook's way: header, ';', inferSchema (an extra pass)."""
    return lower(read_cash_csv(spark, workspace(spark, sf_dir).csv_path, schema=None, infer=True))


@register("csv_scan_checked")
def q_csv_scan_checked(spark, sf_dir):
    """Good rows of a CSV with its columns in another order, one more of them, and some bad cells."""
    return lower(read_cash_csv(spark, workspace(spark, sf_dir).odd_csv_path, on_bad="quarantine"))


@register("csv_rejected")
def q_csv_rejected(spark, sf_dir):
    """How many rows of that file went to the quarantine, by reason."""
    scan = scan_cash_csv(spark, workspace(spark, sf_dir).odd_csv_path)
    return bad_counts(bad_rows(scan)).select("reason", "n_rows")


@register("weekday_dim")
def q_weekday_dim(spark, sf_dir):
    """Weekday dimension rows that occur in the enriched fact."""
    ws = workspace(spark, sf_dir)
    return lower(ws.enriched.select("id", "dzien").distinct())


# ---------------------------------------------------- filters and enrichment ---

@register("filter_day")
def q_filter_day(spark, sf_dir):
    fact = workspace(spark, sf_dir).fact
    return lower(fact.filter(F.col("Data") == F.lit(P.REPORT_DAY).cast("date")))


@register("filter_month")
def q_filter_month(spark, sf_dir):
    fact = workspace(spark, sf_dir).fact
    return lower(reports.one_month(fact, P.REPORT_YEAR, P.REPORT_MONTH))


@register("weekday_enrich")
def q_weekday_enrich(spark, sf_dir):
    fact = workspace(spark, sf_dir).fact
    return lower(enrich.add_weekday(fact, spark))


@register("month_key")
def q_month_key(spark, sf_dir):
    fact = workspace(spark, sf_dir).fact
    return lower(enrich.add_month_key(fact))


# --------------------------------------------------------------- calendar ---

@register("calendar_distinct")
def q_calendar_distinct(spark, sf_dir):
    fact = workspace(spark, sf_dir).fact
    return lower(deadlines.calendar_from_fact(fact))


@register("calendar_head")
def q_calendar_head(spark, sf_dir):
    cal = workspace(spark, sf_dir).calendar
    return lower(cal.select("data1", "Terminy").orderBy("data1").limit(P.CALENDAR_HEAD))


@register("calendar_next_flag")
def q_calendar_next_flag(spark, sf_dir):
    return lower(deadlines.next_day_flag(workspace(spark, sf_dir).calendar_flags))


@register("deadline_nominal")
def q_deadline_nominal(spark, sf_dir):
    return lower(deadlines.nominal_tags(workspace(spark, sf_dir).calendar_flags))


@register("deadline_due")
def q_deadline_due(spark, sf_dir):
    cal = deadlines.deadline_calendar(workspace(spark, sf_dir).calendar_flags)
    return lower(cal.select("data1", "dzien_wolny", "wyk_term"))


@register("deadline_eve")
def q_deadline_eve(spark, sf_dir):
    cal = deadlines.deadline_calendar(workspace(spark, sf_dir).calendar_flags)
    return lower(cal.select("data1", "dzien_wolny", "razemD_1"))


@register("deadline_calendar")
def q_deadline_calendar(spark, sf_dir):
    cal = deadlines.deadline_calendar(workspace(spark, sf_dir).calendar_flags)
    return lower(cal.select("data1", "dzien_wolny", "Terminy"))


@register("deadline_calendar_rows")
def q_deadline_calendar_rows(spark, sf_dir):
    """The calendar of the fact's own dates (with its gaps), rolled over rows as the notebook's lags do."""
    cal = deadlines.deadline_calendar(deadlines.calendar_from_fact(workspace(spark, sf_dir).fact), by="rows")
    return cal.select("data1", "dzien_wolny", F.col("Terminy").alias("terminy"))


@register("deadline_enrich")
def q_deadline_enrich(spark, sf_dir):
    ws = workspace(spark, sf_dir)
    return lower(enrich.add_deadlines(ws.fact, ws.calendar))


# ---------------------------------------------------------------- reports ---

@register("monthly_sums")
def q_monthly_sums(spark, sf_dir):
    return lower(reports.monthly_sums(workspace(spark, sf_dir).enriched))


@register("monthly_sums_published")
def q_monthly_sums_published(spark, sf_dir):
    """The monthly totals kept as a report partitioned by year, read back from the folder."""
    ws = workspace(spark, sf_dir)
    rows = reports.monthly_sums(ws.enriched).withColumn("rok", F.year("miesiac_rok"))
    publish(rows, ws.report_path("monthly"), ["rok"], "whole")
    return lower(published(spark, ws.report_path("monthly")))


@register("monthly_report")
def q_monthly_report(spark, sf_dir):
    return lower(reports.monthly_report(workspace(spark, sf_dir).enriched))


@register("monthly_pivot_nad_kz")
def q_monthly_pivot_nad_kz(spark, sf_dir):
    return lower(reports.monthly_pivot(workspace(spark, sf_dir).enriched, "nad_kz", month_starts(P.PIVOT_YEARS)))


@register("monthly_pivot_zas_pl_r")
def q_monthly_pivot_zas_pl_r(spark, sf_dir):
    return lower(reports.monthly_pivot(workspace(spark, sf_dir).enriched, "zas_pl_R", month_starts(P.PIVOT_YEARS)))


@register("monthly_pivot_selected")
def q_monthly_pivot_selected(spark, sf_dir):
    return lower(reports.monthly_pivot_selected(workspace(spark, sf_dir).enriched, "nad_kz",
                                                P.SELECTED_BRANCHES))


@register("monthly_pivot_selected_zas_pl_r")
def q_monthly_pivot_selected_zas_pl_r(spark, sf_dir):
    return lower(reports.monthly_pivot_selected(workspace(spark, sf_dir).enriched, "zas_pl_R",
                                                P.SELECTED_BRANCHES))


def _daily_pivot_query(measure: str) -> Query:
    def q(spark, sf_dir):
        return lower(reports.daily_pivot(workspace(spark, sf_dir).enriched, measure,
                                         P.REPORT_YEAR, P.REPORT_MONTH))
    q.__doc__ = f"Branch x day matrix of {measure} for the report month."
    return q


for _m in MEASURES:
    register(f"daily_pivot_{_m.lower()}")(_daily_pivot_query(_m))


def _daily_top_query(measure: str) -> Query:
    def q(spark, sf_dir):
        # nations: more branches than the report shows, so the choice matters
        return lower(reports.daily_pivot_top(workspace(spark, sf_dir, "nation").enriched, measure,
                                             P.REPORT_YEAR, P.REPORT_MONTH, P.TOP_N))
    q.__doc__ = f"First branches by name of the daily matrix of {measure}."
    return q


for _m in MEASURES:
    register("daily_pivot_top5" if _m == "nad_kz" else f"daily_pivot_top5_{_m.lower()}")(_daily_top_query(_m))


@register("daily_long")
def q_daily_long(spark, sf_dir):
    return lower(reports.daily_long(workspace(spark, sf_dir).enriched, P.REPORT_YEAR, P.REPORT_MONTH))


@register("branch_month_detail")
def q_branch_month_detail(spark, sf_dir):
    return lower(reports.branch_month_detail(workspace(spark, sf_dir).enriched, P.REPORT_BRANCH,
                                             P.REPORT_YEAR, P.REPORT_MONTH))


@register("weekday_ordered")
def q_weekday_ordered(spark, sf_dir):
    return lower(reports.weekday_ordered(workspace(spark, sf_dir).enriched, P.REPORT_BRANCH,
                                         P.REPORT_YEAR, P.REPORT_MONTHS_PAIR))


@register("weekday_profile")
def q_weekday_profile(spark, sf_dir):
    return lower(reports.weekday_profile(workspace(spark, sf_dir).enriched, P.REPORT_BRANCH,
                                         P.REPORT_YEAR, P.REPORT_MONTHS_PAIR))


@register("series_by_weekday")
def q_series_by_weekday(spark, sf_dir):
    return lower(reports.series_by_weekday(workspace(spark, sf_dir).enriched, P.REPORT_BRANCH))


@register("series_by_deadline")
def q_series_by_deadline(spark, sf_dir):
    return lower(reports.series_by_deadline(workspace(spark, sf_dir).enriched, P.REPORT_BRANCH))
