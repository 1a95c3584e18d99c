"""Monthly, daily, weekday and deadline reports over the enriched fact.

Sums of amounts are exact integer-cent sums (``functions.amounts``), so
totals do not depend on how rows are partitioned.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kasaflow.functions.amounts import exact_sum
from kasaflow.functions.constants import (DEADLINE_LABELS, MEASURES, OTHER_WEEKDAY_RANK,
                                          WEEKDAY_DISPLAY_ORDER)
from kasaflow.functions.dates import days_of_month, in_months, month_range
from kasaflow.functions.formatting import money_text, whole_text

# --- fixed values: report column names, in measure order
MONTHLY_NAMES = {
    "zas_pl_R": "suma_mc_zasilki_do_placowek_R",
    "zas_kz_R": "suma_mc_zasilki_dla_klientaZ_R",
    "nad_pl": "suma_mc_nadmiary_z_placowek",
    "nad_kz": "suma_mc_nadmiary_od_kientaZ",
    "zas_pl_W": "suma_mc_zasilki_do_placowek_W",
    "zas_kz_W": "suma_mc_zasilki_dla_klientaZ_W",
}


def monthly_sums(enriched: DataFrame) -> DataFrame:
    """Per month, the six measure totals rounded to 2 places (numeric)."""
    aggs = [F.round(exact_sum(m), 2).alias(MONTHLY_NAMES[m]) for m in MEASURES]
    return enriched.groupBy("miesiac_rok").agg(*aggs).orderBy("miesiac_rok")


def monthly_report(enriched: DataFrame) -> DataFrame:
    """Same totals as text: '1,234,567.89'."""
    sums = monthly_sums(enriched)
    return sums.select("miesiac_rok", *[money_text(F.col(MONTHLY_NAMES[m])).alias(MONTHLY_NAMES[m])
                                        for m in MEASURES])


def monthly_pivot(enriched: DataFrame, measure: str, months: list[dt.date]) -> DataFrame:
    """Branch x month matrix of a measure's monthly total over the given month
    starts (NULL where a branch has no rows in a month). Headers are ISO dates
    ('1998-07-01'); as they are given, no job looks for them.
    """
    return enriched.groupBy("nazwa_kasy").pivot("miesiac_rok", months).agg(exact_sum(measure))


def monthly_pivot_selected(enriched: DataFrame, measure: str, branches: list[str]) -> DataFrame:
    """Transpose: month rows, one column per chosen branch. The branch filter
    runs before the aggregate."""
    return (enriched.filter(F.col("nazwa_kasy").isin(branches))
            .groupBy("miesiac_rok").pivot("nazwa_kasy", branches).agg(exact_sum(measure)))


def one_month(enriched: DataFrame, year: int, month: int) -> DataFrame:
    lo, hi = month_range(year, month)
    return enriched.filter((F.col("Data") >= F.lit(lo).cast("date")) & (F.col("Data") < F.lit(hi).cast("date")))


def daily_pivot(enriched: DataFrame, measure: str, year: int, month: int) -> DataFrame:
    """Branch x day matrix for every day of one month: the day's value
    (``first``; the fact has one row per (date, branch)), NULL without one."""
    return (one_month(enriched, year, month).groupBy("nazwa_kasy")
            .pivot("Data", days_of_month(year, month)).agg(F.first(measure)))


def daily_pivot_top(enriched: DataFrame, measure: str, year: int, month: int, n: int = 5) -> DataFrame:
    """First ``n`` branches (by name) of the daily pivot."""
    return daily_pivot(enriched, measure, year, month).orderBy("nazwa_kasy").limit(n)


def daily_long(enriched: DataFrame, year: int, month: int) -> DataFrame:
    """All six daily pivots in one long table: (nazwa_kasy, Data, measure, value)."""
    month_df = one_month(enriched, year, month).select("nazwa_kasy", "Data", *MEASURES)
    return month_df.unpivot(["nazwa_kasy", "Data"], MEASURES, "measure", "value")


def branch_month_detail(enriched: DataFrame, branch: str, year: int, month: int) -> DataFrame:
    """One branch, one month: date, tags, morning and evening supply as text."""
    return (one_month(enriched, year, month).filter(F.col("nazwa_kasy") == branch)
            .select("Data", "Terminy",
                    whole_text(F.col("zas_pl_R")).alias("zas_pl_R"),
                    whole_text(F.col("zas_pl_W")).alias("zas_pl_W"))
            .orderBy("Data"))


def weekday_rank(c: Column) -> Column:
    """Monday = 1 ... Sunday = 7, any other value 99."""
    rank = None
    for i, name in enumerate(WEEKDAY_DISPLAY_ORDER, start=1):
        rank = F.when(c == name, i) if rank is None else rank.when(c == name, i)
    return rank.otherwise(OTHER_WEEKDAY_RANK)


def weekday_ordered(enriched: DataFrame, branch: str, year: int, months: list[int],
                    measure: str = "nad_kz") -> DataFrame:
    """One branch, some months, ordered Monday..Sunday then by date."""
    rows = enriched.filter((F.col("nazwa_kasy") == branch) & in_months(F.col("Data"), year, months))
    return (rows.select("Data", "dzien", F.col(measure), weekday_rank(F.col("dzien")).alias("weekday_rank"))
            .orderBy("weekday_rank", "Data"))


def weekday_profile(enriched: DataFrame, branch: str, year: int, months: list[int],
                    measure: str = "nad_kz") -> DataFrame:
    """Average of a measure per weekday (the profile the ordered rows chart)."""
    rows = enriched.filter((F.col("nazwa_kasy") == branch) & in_months(F.col("Data"), year, months))
    return (rows.groupBy("dzien")
            .agg((exact_sum(measure) / F.count(F.lit(1))).alias(f"avg_{measure}"),
                 F.count(F.lit(1)).alias("n_days"))
            .withColumn("weekday_rank", weekday_rank(F.col("dzien")))
            .orderBy("weekday_rank"))


def series_by_weekday(enriched: DataFrame, branch: str, measure: str = "nad_kz") -> DataFrame:
    """One branch's daily series, one line per weekday (one pass, not 7 jobs)."""
    return (enriched.filter((F.col("nazwa_kasy") == branch) & F.col("dzien").isin(WEEKDAY_DISPLAY_ORDER))
            .select("Data", "dzien", measure).orderBy("dzien", "Data"))


def series_by_deadline(enriched: DataFrame, branch: str, measure: str = "zas_pl_R",
                       labels: list[str] = DEADLINE_LABELS) -> DataFrame:
    """One branch's values on deadline days, one line per label (exact label
    match, as in the source: glued days such as ``T1T5D-1`` are not in any line)."""
    return (enriched.filter((F.col("nazwa_kasy") == branch) & F.col("Terminy").isin(labels))
            .select("Data", "Terminy", measure).orderBy("Terminy", "Data"))
