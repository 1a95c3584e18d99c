"""Date helpers, all JVM-side expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from kasaflow.functions.constants import DAY_OFF, WORKING_DAY

# --- fixed values: day-off rule of the TPC-H binding -------------------------
# Saturday and Sunday, plus these month-day holidays (MM-dd).
BINDING_HOLIDAYS = ["01-01", "05-01", "05-03", "12-25", "12-26"]
WEEKEND_DAYOFWEEK = [1, 7]


def weekday_number(d: Column) -> Column:
    """Sunday = 1 ... Saturday = 7."""
    return F.dayofweek(d)


def month_key(d: Column) -> Column:
    """First day of the month, as a DATE (same value as to_date(date_format(d,'yyyy-MM')))."""
    return F.trunc(d, "MM")


def binding_day_flag(d: Column) -> Column:
    """'DW' on weekends and the binding's holidays, else 'D'."""
    off = F.dayofweek(d).isin(WEEKEND_DAYOFWEEK) | F.date_format(d, "MM-dd").isin(BINDING_HOLIDAYS)
    return F.when(d.isNull(), F.lit(None).cast("string")).when(off, DAY_OFF).otherwise(WORKING_DAY)


def month_range(year: int, month: int) -> tuple[str, str]:
    """Half-open [first day, first day of next month) as ISO strings.

    Range predicates on the date column push down to the Parquet scan;
    year()/month() predicates do not.
    """
    start = f"{year:04d}-{month:02d}-01"
    ny, nm = (year + 1, 1) if month == 12 else (year, month + 1)
    return start, f"{ny:04d}-{nm:02d}-01"


def month_starts(years: list[int]) -> list[dt.date]:
    """First days of all months of the given years."""
    return [dt.date(y, m, 1) for y in years for m in range(1, 13)]


def days_of_month(year: int, month: int) -> list[dt.date]:
    start, end = (dt.date.fromisoformat(d) for d in month_range(year, month))
    return [start + dt.timedelta(days=i) for i in range((end - start).days)]


def in_months(d: Column, year: int, months: list[int]) -> Column:
    """Disjunction of half-open month ranges (pushable)."""
    cond = None
    for m in months:
        lo, hi = month_range(year, m)
        part = (d >= F.lit(lo).cast("date")) & (d < F.lit(hi).cast("date"))
        cond = part if cond is None else (cond | part)
    return cond
