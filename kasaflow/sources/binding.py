"""Daily cash fact built from the TPC-H-style test tables.

No cash CSV ships with the tests, so the fact is derived from the star schema:

* ``Data``        = ship date of the line item
* ``nazwa_kasy``  = region (or nation) of the supplier
* six measures    = sums of the extended price per (return flag, line status)
* ``dzien_wolny`` = the binding's day-off rule (weekends and five holidays)

Plan at scale: one scan of ``lineitem`` (five columns, date range pushed down
when given) joined to a supplier -> branch map, then a two-phase aggregate on
(date, branch). The map-side partial aggregate collapses every task's rows to
at most (days x branches) before the shuffle, so a hot supplier or branch does
not concentrate rows in one reducer.

Broadcasts are explicit and size-checked: the nation/region map (25 rows in
TPC-H) and the supplier -> branch map (one row per supplier) are broadcast
only below a row bound; above it the rows are first summed up by (supplier,
day), map-side, so that a hot supplier reaches the sort-merge join on
``l_suppkey`` as a few thousand rows. Without
the explicit hint Catalyst's default size estimate multiplies the join inputs
of the supplier map and picks ``lineitem`` as the build side at small scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kasaflow.functions.amounts import cents_to_amount, to_cents
from kasaflow.functions.dates import binding_day_flag
from kasaflow.plans.sizing import broadcast_if, row_count_at_most

# --- fixed values: (return flag, line status) -> measure ----------------------
BINDING_MEASURES = [
    ("A", "F", "zas_pl_R"),
    ("A", "O", "zas_kz_R"),
    ("N", "F", "nad_pl"),
    ("N", "O", "nad_kz"),
    ("R", "F", "zas_pl_W"),
    ("R", "O", "zas_kz_W"),
]

GEO_MAX_ROWS = 100_000
SUPPLIER_MAX_BROADCAST_ROWS = 2_000_000  # ~2M (key, name) pairs, a few tens of MB


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_date(kind: str) -> Column:
    """The calendar day of ``l_shipdate``: as written for dates and timestamps without a
    zone, the UTC day for instants, whatever the session's time zone is."""
    c = F.col("l_shipdate")
    return F.to_date(F.expr("timestampadd(MICROSECOND, unix_micros(l_shipdate), TIMESTAMP_NTZ'1970-01-01')")) if kind == "timestamp" else c.cast("date")


def supplier_branches(spark: SparkSession, sf_dir: str, level: str = "region",
                      broadcast_geo: bool | None = None) -> DataFrame:
    """(s_suppkey, nazwa_kasy): each supplier's region (or nation) name.

    The nation -> branch map has one row per nation (region keys are unique),
    so its broadcast is bounded by the nation table's row count.
    """
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    if broadcast_geo is None:
        broadcast_geo = row_count_at_most(nation, GEO_MAX_ROWS)
    if level == "nation":
        geo = nation.select("n_nationkey", F.col("n_name").alias("nazwa_kasy"))
    else:
        region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
        geo = (nation.join(broadcast_if(region, broadcast_geo), nation.n_regionkey == region.r_regionkey)
               .select("n_nationkey", F.col("r_name").alias("nazwa_kasy")))
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    geo = broadcast_if(geo, broadcast_geo)
    return (supplier.join(geo, supplier.s_nationkey == geo.n_nationkey)
            .select("s_suppkey", "nazwa_kasy"))


def cash_fact(spark: SparkSession, sf_dir: str, level: str = "region",
              start: str | None = None, end: str | None = None,
              supplier_broadcast_rows: int = SUPPLIER_MAX_BROADCAST_ROWS) -> DataFrame:
    """One row per (Data, nazwa_kasy) with the six daily measures (DOUBLE).

    Sums are exact integer cents (LONG, overflow-checked in ANSI mode) turned
    into DOUBLE once, so the values do not depend on partitioning, and the
    aggregate stays in whole-stage codegen (a DECIMAL(28,2) buffer would not). ``start``/``end`` bound ``Data`` half-open and
    reach the Parquet scan as pushed filters.
    """
    lineitem = read_table(spark, sf_dir, "lineitem")
    li_type = dict(lineitem.dtypes)["l_shipdate"]
    li = lineitem.select(
        "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus",
        ship_date(li_type).alias("Data"))
    if start is not None:
        li = li.filter(F.col("Data") >= F.lit(start).cast("date"))
    if end is not None:
        li = li.filter(F.col("Data") < F.lit(end).cast("date"))
    # The map has at most one row per supplier: bound it by the supplier table.
    small = row_count_at_most(read_table(spark, sf_dir, "supplier"), supplier_broadcast_rows)
    branches = broadcast_if(supplier_branches(spark, sf_dir, level), small)
    cents = to_cents(F.col("l_extendedprice"))
    parts = {name: F.when((F.col("l_returnflag") == rf) & (F.col("l_linestatus") == ls), cents)
             for rf, ls, name in BINDING_MEASURES}
    if not small:
        # A hot supplier collapses to its days map-side, before anything is dealt out by supplier.
        li = li.groupBy("l_suppkey", "Data").agg(*[F.sum(c).alias(name) for name, c in parts.items()])
        parts = {name: F.col(name) for name in parts}
    joined = li.join(branches, li.l_suppkey == branches.s_suppkey)
    sums = [F.coalesce(cents_to_amount(F.sum(c)), F.lit(0.0)).alias(name) for name, c in parts.items()]
    fact = joined.groupBy("Data", "nazwa_kasy").agg(*sums)
    return fact.select("Data", "nazwa_kasy", binding_day_flag(F.col("Data")).alias("dzien_wolny"),
                       *[name for _, _, name in BINDING_MEASURES])
