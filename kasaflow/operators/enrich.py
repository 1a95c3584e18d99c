"""Fact enrichment: weekday keys, month key, deadline tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kasaflow.functions.dates import month_key, weekday_number
from kasaflow.sources.dims import weekday_dim


def add_weekday(fact: DataFrame, spark: SparkSession) -> DataFrame:
    """Adds ``id_dnia_tygodnia`` (Sunday = 1) and the weekday name.

    Inner equi-join on differently named keys; both keys are kept
    (``id_dnia_tygodnia`` int, ``id`` bigint). The dimension has 7 rows by
    construction, so the broadcast is bounded.
    """
    d = fact.withColumn("id_dnia_tygodnia", weekday_number(F.col("Data")))
    dim = weekday_dim(spark)
    return d.join(F.broadcast(dim), d.id_dnia_tygodnia == dim.id, "inner")


def add_month_key(df: DataFrame) -> DataFrame:
    """Adds ``miesiac_rok``: the first day of the row's month (DATE)."""
    return df.withColumn("miesiac_rok", month_key(F.col("Data")))


def add_deadlines(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Inner join of facts to the deadline calendar on date; drops the calendar key.

    A date present twice in the calendar (two day-off flags) fans out, as in
    the source. No hint: the calendar is a written table with one row a day,
    and its size lets Spark choose a broadcast or a shuffle join.
    """
    cal = calendar.select("data1", "Terminy")
    return df.join(cal, df.Data == cal.data1, "inner").drop("data1")


def enrich(fact: DataFrame, calendar: DataFrame, spark: SparkSession) -> DataFrame:
    """Fact + weekday + month key + ``Terminy`` in one plan."""
    return add_deadlines(add_month_key(add_weekday(fact, spark)), calendar)
