"""The batch enrichment and monthly totals applied to a stream of daily files.

The source notebook reads one CSV in batch; when daily files land in a folder,
the same stages run incrementally:

* ``read_cash_stream``   - file stream of ';' CSVs, bound by their header; bad
                           rows are kept apart as in the batch reader
* ``enrich_stream``      - weekday and month keys plus deadline tags, as
                           stream-static joins (weekday dimension: 7 rows;
                           calendar: one row per day, broadcast after a
                           row-count check)
* ``monthly_totals_stream`` - the monthly sums of the six measures; every
                           batch emits the months it changed (update mode), so
                           rows that arrive late correct their month instead of
                           being dropped. State is one row a month of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kasaflow.functions.amounts import cents_to_amount, to_cents
from kasaflow.functions.constants import MEASURES
from kasaflow.operators.enrich import add_deadlines, add_month_key, add_weekday
from kasaflow.operators.reports import MONTHLY_NAMES
from kasaflow.sources.csv_source import CORRUPT, bound, checked, good_rows, headers


def scan_cash_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 100,
                     header: list[str] | None = None) -> DataFrame:
    """Rows of the files as they land, as ``scan_cash_csv`` gives them. The columns' names come from ``header``
    or from the files already there; a file with another header later on stops the stream."""
    if header is None:
        found = headers(spark, folder)
        if len(found) != 1:
            raise ValueError(f"{folder} has {len(found)} different headers; give the stream's own")
        header = list(next(iter(found)))
    names = bound(header)
    # enforceSchema=false compares every file's header with these names
    cells = T.StructType([T.StructField(n, T.StringType()) for n in header])
    raw = (spark.readStream.schema(cells).option("header", "true").option("sep", ";").option("enforceSchema", "false")
           .option("maxFilesPerTrigger", max_files_per_trigger).csv(folder))
    return checked(raw.withColumn(CORRUPT, F.lit(None).cast("string")), names)


def read_cash_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 100, header: list[str] | None = None,
                     on_bad: str = "fail") -> DataFrame:
    scan = scan_cash_stream(spark, folder, max_files_per_trigger, header)
    return good_rows(scan.withColumn("cells", F.to_json("cells")), on_bad=on_bad)


def enrich_stream(stream: DataFrame, calendar: DataFrame, spark: SparkSession) -> DataFrame:
    return add_deadlines(add_month_key(add_weekday(stream, spark)), calendar)


def monthly_totals_stream(enriched: DataFrame) -> DataFrame:
    """Monthly totals (exact cent sums) for an ``update`` mode sink: each batch
    emits the new total of every month it touched; the last one emitted for a
    month holds. No watermark: its state never needs to be cut (twelve rows a
    year), so no row is too late."""
    sums = [F.sum(to_cents(F.col(m))).alias(f"_{m}") for m in MEASURES]
    agg = enriched.groupBy(F.trunc("Data", "MM").alias("miesiac_rok")).agg(*sums)
    return agg.select("miesiac_rok", *[F.round(cents_to_amount(F.col(f"_{m}")), 2).alias(MONTHLY_NAMES[m]) for m in MEASURES])
