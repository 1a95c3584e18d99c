"""Every (branch, measure) pair as a daily time series, all series at once.

Series are long DataFrames ``(nazwa_kasy, measure, Data, value, ...)``. All
per-series steps are window functions over ``partitionBy(branch, measure)
.orderBy(Data)`` with the same spec, so Spark shuffles once and sorts once per
plan, and the grouped aggregates that follow reuse that partitioning.

Size bound: a series holds one row per calendar day of the data's span,
whatever the data volume (a century is 36,525 rows), so a window partition
never grows with the number of source rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kasaflow.functions.constants import MEASURES

KEYS = ["nazwa_kasy", "measure"]
HIST_BINS = 20
TEST_SIZE = 0.1


SERIES_ORDER_SQL = "PARTITION BY nazwa_kasy, measure ORDER BY Data"


def lags_sql(col: str, lags, prefix: str, default: str | None = None) -> list[str]:
    """SQL text for lag(col, k) over the series order, one column per k.

    Bulk expressions are built as text: one ``selectExpr`` call instead of
    several Py4J calls per Column object."""
    out = []
    for k in lags:
        e = f"lag({col}, {k}) OVER ({SERIES_ORDER_SQL})"
        if default is not None:
            e = f"coalesce({e}, {default})"
        out.append(f"{e} AS {prefix}{k}")
    return out


def by_series() -> Window:
    return Window.partitionBy(*KEYS).orderBy("Data")


def whole_series() -> Window:
    return by_series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def running() -> Window:
    return by_series().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def densify(fact: DataFrame, start: str, end: str, measures: list[str] = MEASURES) -> DataFrame:
    """Wide fact with one row per (branch, day) of [start, end]; a day without a
    row is 0, a NULL in a row stays NULL.

    Each branch row generates its own day sequence (a generator, not a cross
    join), then the fact is left-joined on (branch, day).
    """
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    grid = fact.select("nazwa_kasy").distinct().select("nazwa_kasy", F.explode(days).alias("Data"))
    rows = fact.select("nazwa_kasy", "Data", *measures, F.lit(True).alias("known"))
    joined = grid.join(rows, ["nazwa_kasy", "Data"], "left")
    return joined.select("nazwa_kasy", "Data", *[F.when(F.col("known"), F.col(m)).otherwise(F.lit(0.0)).alias(m)
                                                 for m in measures])


def series_long(fact: DataFrame, start: str, end: str, measures: list[str] = MEASURES) -> DataFrame:
    """(nazwa_kasy, measure, Data, value): one row per series and day."""
    return (densify(fact, start, end, measures)
            .unpivot(["nazwa_kasy", "Data"], measures, "measure", "value")
            .select(*KEYS, "Data", "value"))


def series_diff(series: DataFrame) -> DataFrame:
    """Adds ``diff`` = value - previous day's value (NULL on the first day)."""
    return series.withColumn("diff", F.col("value") - F.lag("value").over(by_series()))


def test_count(n: Column, test_size: float = TEST_SIZE) -> Column:
    """ceil(test_size * n) in double arithmetic, as the usual chronological
    split helper computes the test size (for test_size = 0.1 this equals
    ceil(n / 10) for every n below 400 at least)."""
    return F.ceil(F.lit(float(test_size)) * n).cast("long")


def train_test_split(diffed: DataFrame, test_size: float = TEST_SIZE) -> DataFrame:
    """Chronological split: the last ceil(test_size * n) days of each series are
    'test'. Adds rn, n, n_test, split."""
    n = F.count(F.lit(1)).over(whole_series())
    out = diffed.withColumns({"rn": F.row_number().over(by_series()).cast("long"), "n": n})
    out = out.withColumn("n_test", test_count(F.col("n"), test_size))
    return out.withColumn("split", F.when(F.col("rn") > F.col("n") - F.col("n_test"), "test")
                          .otherwise("train"))


def last_train_value(split: DataFrame) -> DataFrame:
    """Per series, the last training day and its value (start of un-differencing)."""
    return (split.filter(F.col("split") == "train").groupBy(*KEYS)
            .agg(F.max("Data").alias("last_date"), F.max_by("value", "Data").alias("last_value")))


def train_series(split: DataFrame) -> DataFrame:
    """Training rows; the first day's NULL difference becomes 0."""
    return (split.filter(F.col("split") == "train")
            .withColumn("diff", F.when(F.col("rn") == 1, F.coalesce(F.col("diff"), F.lit(0.0)))
                        .otherwise(F.col("diff"))))


def null_counts(rows: DataFrame) -> DataFrame:
    """Per series: row count and NULLs in each column."""
    return rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("Data").isNull()).alias("null_data"),
        F.count_if(F.col("value").isNull()).alias("null_value"),
        F.count_if(F.col("diff").isNull()).alias("null_diff"))


def undiff(start: Column, steps: Column) -> Column:
    """start + running sum of steps (over the series order)."""
    return start + F.sum(steps).over(running())


def undiff_actual(split: DataFrame, digits: int = 2) -> DataFrame:
    """Test days: last training value + running sum of the test differences,
    rounded to ``digits`` (amounts are cents).

    One window pass: the start value is picked over the whole partition, so
    no join back to a per-series table is needed.
    """
    start = F.first(F.when(F.col("rn") == F.col("n") - F.col("n_test"), F.col("value")),
                    ignorenulls=True).over(whole_series())
    steps = F.when(F.col("split") == "test", F.col("diff"))
    out = split.withColumn("start_value", start)
    out = out.withColumn("level", F.round(undiff(F.col("start_value"), steps), digits))
    return (out.filter(F.col("split") == "test")
            .select(*KEYS, "Data", "value", "diff", "level"))


def diff_histogram(diffed: DataFrame, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width histogram of each series' differences (last bin closed).

    bin = floor((x - min) * bins / (max - min)), capped at bins - 1; a constant
    series puts everything in bin 0. Every series gets all its bins, empty ones
    with 0; one conditional count for each bin, so one shuffle.
    """
    x = diffed.filter(F.col("diff").isNotNull())
    w = Window.partitionBy(*KEYS)
    x = x.withColumns({"lo": F.min("diff").over(w), "hi": F.max("diff").over(w)})
    width = F.col("hi") - F.col("lo")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("diff") - F.col("lo")) * F.lit(float(bins)) / width)
                .cast("int")))
    counts = F.array(*[F.count_if(F.col("bin") == k) for k in range(bins)])
    per = x.withColumn("bin", b).groupBy(*KEYS, "lo", "hi").agg(counts.alias("counts"))
    counted = per.select(*KEYS, "lo", "hi", F.posexplode("counts").alias("bin", "n"))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return counted.select(*KEYS, "bin",
                          (F.col("lo") + F.col("bin") * step).alias("bin_lo"),
                          (F.col("lo") + (F.col("bin") + 1) * step).alias("bin_hi"),
                          "n")


def measure_correlation(fact: DataFrame, measures: list[str] = MEASURES) -> DataFrame:
    """Pearson correlation of every measure pair within each branch (long form)."""
    pairs = [(a, b) for i, a in enumerate(measures) for b in measures[i + 1:]]
    aggs = [F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs]
    wide = fact.groupBy("nazwa_kasy").agg(*aggs)
    entries = F.array(*[F.struct(F.lit(a).alias("measure_a"), F.lit(b).alias("measure_b"),
                                 F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])
    return (wide.select("nazwa_kasy", F.explode(entries).alias("e"))
            .select("nazwa_kasy", "e.measure_a", "e.measure_b", F.round("e.r", 9).alias("corr")))


def acf(diffed: DataFrame, nlags: int = 30, column: str = "diff", digits: int | None = 9) -> DataFrame:
    """Autocorrelation r_0..r_nlags of each series' non-NULL ``column``.

    r_k = sum_t u_t u_{t-k} / sum_t u_t^2 with u = x - mean(x) (the biased
    estimator). Lags come from one window spec; the grouped sums reuse the
    window's partitioning, so there is a single shuffle.
    """
    x = diffed.filter(F.col(column).isNotNull()).select(*KEYS, "Data", F.col(column).alias("x"))
    u = F.col("x") - F.avg("x").over(whole_series())
    x = x.withColumn("u", u)
    x = x.selectExpr("*", *lags_sql("u", range(1, nlags + 1), "l"))
    sums = ["sum(u * u) AS s0"] + [f"sum(u * l{k}) AS s{k}" for k in range(1, nlags + 1)]
    g = x.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("nobs"), *[F.expr(e) for e in sums])
    entries = ", ".join(f"named_struct('lag', {k}, 's', s{k})" for k in range(0, nlags + 1))
    arr = F.expr(f"array({entries})")
    out = g.select(*KEYS, "nobs", "s0", F.explode(arr).alias("e"))
    r = F.try_divide(F.coalesce(F.col("e.s"), F.lit(0.0)), F.col("s0"))
    return out.select(*KEYS, F.col("e.lag").cast("int").alias("lag"),
                      (r if digits is None else F.round(r, digits)).alias("acf"),
                      "nobs")
