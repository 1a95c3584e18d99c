"""Materialised stages shared by all reports.

Every report reads the same enriched daily fact. Recomputing it from
``lineitem`` for each report would rescan the largest table each time, so the
workspace writes each stage once to the session's shared checkpoint folder and
reads it back as Parquet:

* ``fact``      - one scan of the source tables -> (days x branches) rows
* ``calendar``  - deadline calendar, one row per day of the fact's span
* ``enriched``  - fact + weekday + month key + deadline tags
* ``series``    - every (branch, measure) daily series, differenced and split
* forecasts and regression rows that several queries follow up

The written tables cut lineage (a lost executor re-reads Parquet instead of
re-running the scan) and give later reports Parquet pushdown on ``Data``.
Workspaces are memoised per (application, source folder and the state of its
files, branch level).
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kasaflow.operators.deadlines import deadline_calendar, dense_calendar
from kasaflow.operators.enrich import enrich
from kasaflow.operators.forecast import seasonal_ma_forecast
from kasaflow.operators.lagreg import forecast_from_rows, order_search, stage1_fit, stage_rows
from kasaflow.operators.sarma import FULL, SEASONAL, exact_fit, order_search_refit, product_fit
from kasaflow.operators.series import KEYS, series_diff, series_long, train_series, train_test_split
from kasaflow.session import ensure_checkpoint_dir
from kasaflow.sources.binding import cash_fact
from kasaflow.sources.csv_source import bad_counts, bad_rows, good_rows, read_cash_csv, scan_cash_csv, write_cash_csv

_LOCK = threading.Lock()
_WORKSPACES: dict[tuple, "CashWorkspace"] = {}


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/kasaflow/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Names, sizes and times of the files under ``paths`` (through Hadoop's file
    system, so any store that Spark reads): changed input gives a new workspace."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            each = fs.listFiles(path, True)  # partition folders too: their files need not touch the top folder
            while each.hasNext():
                f = each.next()
                found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(found)).encode()).hexdigest()[:12]


def materialize_bucketed(spark: SparkSession, df: DataFrame, name: str, keys: list[str], order: list[str]) -> DataFrame:
    """Like ``materialize``, in buckets by ``keys`` sorted by ``order``: windows and grouped sums over the keys then
    need no shuffle. The catalog only lends its name while the table is written."""
    table = f"kasaflow_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(buckets, *keys).write.format("parquet").mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, *order)
     .option("path", f"{ensure_checkpoint_dir(spark).rstrip('/')}/kasaflow/{name}").saveAsTable(table))
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


SOURCE_TABLES = ["lineitem", "supplier", "nation", "region"]


class CashWorkspace:
    """Materialised stages over one fact: the test tables' binding
    (``CashWorkspace(spark, sf_dir)``), a cash CSV (``from_csv``) or any frame
    with the fact's columns (``from_fact``)."""

    def __init__(self, spark: SparkSession, sf_dir: str, level: str = "region",
                 source: Callable[[], DataFrame] | None = None, files: list[str] | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.level = level
        self._scan: Callable[[], DataFrame] | None = None
        self._source = source or (lambda: cash_fact(spark, self.sf_dir, level))
        files = [f"{self.sf_dir}/{t}.parquet" for t in SOURCE_TABLES] if files is None else files
        self._tag = hashlib.sha1(f"{self.sf_dir}|{level}|{fingerprint(spark, files)}".encode()).hexdigest()[:12]
        self._made: dict[str, object] = {}
        self._lock = threading.RLock()  # one writer per stage table

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, on_bad: str = "fail", **options) -> CashWorkspace:
        """Workspace over a ';' CSV of daily cash (``options`` as for ``read_cash_csv``). With
        ``on_bad='quarantine'`` bad rows go to ``rejected`` and the stages are built from the others."""
        if on_bad != "quarantine":
            return cls(spark, path, "csv", lambda: read_cash_csv(spark, path, on_bad=on_bad, **options), [path])
        ws = cls(spark, path, "csv-checked", lambda: good_rows(ws.scanned, on_bad=on_bad), [path])
        ws._scan = lambda: scan_cash_csv(spark, path, **options)
        return ws

    @classmethod
    def from_fact(cls, fact: DataFrame, name: str) -> CashWorkspace:
        """Workspace over a frame with the fact's columns. Its stages are its own: another workspace of the
        same name does not touch them."""
        return cls(fact.sparkSession, f"{name}-{uuid.uuid4().hex}", "frame", lambda: fact, [])

    def _stage(self, name: str, build: Callable[[], DataFrame], keys: list[str] | None = None, order: list[str] | None = None):
        with self._lock:
            if name not in self._made:
                path = f"{name}-{self._tag}"
                self._made[name] = (materialize(self.spark, build(), path) if keys is None
                                    else materialize_bucketed(self.spark, build(), path, keys, order or []))
            return self._made[name]

    @property
    def fact(self) -> DataFrame:
        return self._stage("fact", self._source)

    @property
    def scanned(self) -> DataFrame:
        """Every row of a CSV with the reasons against it, read and judged once."""
        return self._stage("scanned", self._scan)

    @property
    def rejected(self) -> DataFrame:
        """Rows of a CSV that could not be read whole: (file, reasons, cells, line)."""
        return bad_rows(self.scanned)

    @property
    def rejected_counts(self) -> DataFrame:
        return bad_counts(self.rejected)

    @property
    def csv_path(self) -> str:
        """The fact as a ';' CSV in the shared folder, written once."""
        with self._lock:
            if "csv" not in self._made:
                path = ensure_checkpoint_dir(self.spark).rstrip("/") + f"/kasaflow/csv-{self._tag}"
                write_cash_csv(self.fact, path)
                self._made["csv"] = path
            return self._made["csv"]

    @property
    def odd_csv_path(self) -> str:
        """The fact as a CSV that only its header explains: other order, a column more, and on two days of
        each month a cell that cannot be read."""
        with self._lock:
            if "oddcsv" not in self._made:
                path = ensure_checkpoint_dir(self.spark).rstrip("/") + f"/kasaflow/oddcsv-{self._tag}"
                day = F.dayofmonth("Data")
                cells = {"uwagi": F.lit("a;b"), **{c: F.col(c).cast("string") for c in reversed(self.fact.columns)}}
                cells["nad_kz"] = F.when(day == 13, F.lit("x1")).otherwise(cells["nad_kz"])
                cells["Data"] = F.when(day == 29, F.lit("29 luty")).otherwise(cells["Data"])
                write_cash_csv(self.fact.select(*[cell.alias(c) for c, cell in cells.items()]), path)
                self._made["oddcsv"] = path
            return self._made["oddcsv"]

    def report_path(self, name: str) -> str:
        """Where the reports of this workspace are published in the shared folder."""
        return f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/kasaflow/reports-{self._tag}/{name}"

    @property
    def span(self) -> tuple[str, str]:
        """(first, last) date of the fact as ISO strings (one tiny aggregate)."""
        with self._lock:
            if "span" not in self._made:
                row = self.fact.agg(F.min("Data").alias("lo"), F.max("Data").alias("hi")).first()
                self._made["span"] = (row["lo"].isoformat(), row["hi"].isoformat())
            return self._made["span"]

    @property
    def calendar_flags(self) -> DataFrame:
        return dense_calendar(self.fact)

    @property
    def calendar(self) -> DataFrame:
        return self._stage("calendar", lambda: deadline_calendar(self.calendar_flags))

    @property
    def series(self) -> DataFrame:
        """Daily series of every (branch, measure), differenced and split
        (KEYS, Data, value, diff, rn, n, n_test, split); days x series rows, in
        buckets by series and sorted by day."""
        return self._stage("series", lambda: train_test_split(series_diff(series_long(self.fact, *self.span))), KEYS, ["Data"])

    @property
    def enriched(self) -> DataFrame:
        return self._stage("enriched", lambda: enrich(self.fact, self.calendar, self.spark))

    @property
    def seasonal_forecast(self) -> DataFrame:
        """Forecast of the (0,1,0)(0,1,1,7) model, used by its five followers."""
        return self._stage("seasonal", lambda: seasonal_ma_forecast(self.series))

    @property
    def lag_rows(self) -> DataFrame:
        """Stage-1 residuals and lags of the lag regression, used by its fit, forecast and order search."""
        return self._stage("lagrows", lambda: stage_rows(train_series(self.series), self.lag_coefficients))

    @property
    def lag_coefficients(self) -> DataFrame:
        return self._stage("lagcoef", lambda: stage1_fit(train_series(self.series)))

    @property
    def lag_forecast(self) -> DataFrame:
        return self._stage("lagforecast", lambda: forecast_from_rows(self.series, self.lag_rows))

    @property
    def factors(self) -> DataFrame:
        """Product structure of the (2,0,2)(2,0,1,7) model by least squares; one row a series."""
        return self._stage("factors", lambda: product_fit(self.lag_rows))

    @property
    def exact_seasonal(self) -> DataFrame:
        """Exact-likelihood fit and forecast of the (0,1,0)(0,1,1,7) model; one row a series."""
        return self._stage("exactseasonal", lambda: exact_fit(self.series, SEASONAL, "value"))

    @property
    def exact_full(self) -> DataFrame:
        """Exact-likelihood fit and forecast of the (2,0,2)(2,0,1,7) model; one row a series."""
        return self._stage("exactfull", lambda: exact_fit(self.series, FULL, "diff", self.factors))

    @property
    def order_refit(self) -> DataFrame:
        """Stepwise order search with the chosen model's exact likelihood; one row a series."""
        return self._stage("orderrefit", lambda: order_search_refit(
            self.series, write=lambda df, name: self._stage(name, lambda: df)))

    @property
    def order_search(self) -> DataFrame:
        return self._stage("orders", lambda: order_search(
            self.series, write=lambda df, name: self._stage(name, lambda: df)))


def workspace(spark: SparkSession, sf_dir: str, level: str = "region") -> CashWorkspace:
    fresh = CashWorkspace(spark, sf_dir, level)  # lists the input files, reads none
    key = (spark.sparkContext.applicationId, fresh._tag)
    with _LOCK:
        return _WORKSPACES.setdefault(key, fresh)
