import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as E  # noqa: E402
from kasaflow.plans.catalog import queries  # noqa: E402
from kasaflow.plans.workspace import workspace  # noqa: E402
from kasaflow.sources.binding import cash_fact  # noqa: E402

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _single_partitions_are_aggregates(plan):
    """Every exchange to one partition gets one row a task: the partial result of an ungrouped aggregate."""
    lines = plan.splitlines()
    return all("HashAggregate(keys=[], functions=[partial_" in lines[i + 1]
               for i, line in enumerate(lines) if "Exchange SinglePartition" in line)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "miesiac_rok"


def test_fact_grain_unique(spark):
    fact = workspace(spark, SF).fact
    assert fact.groupBy("Data", "nazwa_kasy").count().filter("count > 1").count() == 0


def test_binding_scan_prunes_and_broadcasts_small_side(spark):
    df = cash_fact(spark, SF, start="1998-07-01", end="1998-08-01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    # supplier map is the broadcast side, lineitem is streamed
    assert "BroadcastHashJoin" in plan
    text = df._jdf.queryExecution().toString()
    scan = [line for line in text.splitlines() if "FileScan" in line and "l_shipdate" in line]
    assert scan and all("l_tax" not in line and "l_shipdate" in line.split("PushedFilters")[1].split("]")[0] for line in scan)


def test_no_single_partition_window_in_calendar(spark):
    plan = _plan(queries()["deadline_calendar"](spark, SF))
    assert "Window" not in plan and _single_partitions_are_aggregates(plan)


def test_no_row_at_a_time_python_udf(spark):
    for name in ["monthly_sums", "deadline_enrich", "acf", "forecast_seasonal_ma"]:
        plan = _plan(queries()[name](spark, SF))
        assert "BatchEvalPython" not in plan, name


def test_csv_scan_twice_leaves_the_first_frame_readable(spark):
    fact = workspace(spark, SF).fact
    first = queries()["csv_scan"](spark, SF)
    queries()["csv_scan_inferred"](spark, SF)
    assert queries()["csv_scan"](spark, SF).count() == fact.count() == first.count()


def _cash_rows(days):
    import datetime as dt
    import math
    out = []
    for i in range(days):
        d = dt.date(2024, 1, 1) + dt.timedelta(days=i)
        off = "DW" if d.weekday() >= 5 or d == dt.date(2024, 5, 15) else "D"  # 15 May: off by the file, not by the rule
        for k, b in enumerate(("Houston", "Miami")):
            out.append((d, b, off, *[round(1000 + 100 * math.sin(i * (m + 1)) + 10 * (i % 7) + k, 2) for m in range(6)]))
    return out


def test_csv_to_report_to_forecast(spark, tmp_path):
    from kasaflow.operators import reports
    from kasaflow.operators.forecast import forecast_compare
    from kasaflow.plans.workspace import CashWorkspace
    from kasaflow.sources.csv_source import CASH_SCHEMA, write_cash_csv
    rows = _cash_rows(200)
    write_cash_csv(spark.createDataFrame(rows, CASH_SCHEMA), str(tmp_path / "cash"))
    ws = CashWorkspace.from_csv(spark, str(tmp_path / "cash"))
    tags = {r.data1.isoformat(): r.Terminy for r in ws.calendar.collect()}
    assert tags["2024-05-14"] == "T15" and tags["2024-05-13"] == "T15D-1"  # the file's own flag decides
    sums = {r.miesiac_rok.isoformat(): r.suma_mc_nadmiary_od_kientaZ for r in reports.monthly_sums(ws.enriched).collect()}
    assert sums["2024-02-01"] == round(sum(r[6] for r in rows if r[0].month == 2), 2)
    assert forecast_compare(ws.seasonal_forecast).count() == 2 * 6 * 20
    assert forecast_compare(ws.lag_forecast).count() == 2 * 6 * 20
    same = CashWorkspace.from_fact(spark.createDataFrame(rows, CASH_SCHEMA), f"frame-{tmp_path.name}")
    assert sorted(map(tuple, same.calendar.select("data1", "Terminy").collect())) == \
        sorted(map(tuple, ws.calendar.select("data1", "Terminy").collect()))
    # new rows in the folder: a new workspace sees them
    write_cash_csv(spark.createDataFrame(_cash_rows(210), CASH_SCHEMA), str(tmp_path / "cash"))
    assert CashWorkspace.from_csv(spark, str(tmp_path / "cash")).fact.count() == 420


def test_calendar_plans_scan_the_fact(spark):
    for name in ("calendar_next_flag", "deadline_nominal", "deadline_due", "deadline_eve", "deadline_calendar"):
        assert "FileScan" in _plan(queries()[name](spark, SF)), name


def test_hot_supplier_collapses_before_the_shuffle_join(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(cash_fact(spark, SF, supplier_broadcast_rows=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = plan.index("SortMergeJoin")
    assert "keys=[l_suppkey" in plan[join:]  # the aggregate by supplier and day is below the join


def test_file_checkpoint_folder_is_refused_on_a_cluster(spark):
    import pytest
    from types import SimpleNamespace
    from kasaflow.session import ensure_checkpoint_dir
    conf = SimpleNamespace(get=lambda k, d=None: "file:/tmp/x")
    sc = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None, getConf=lambda: conf)
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc))


def _as_cluster(monkeypatch, spark, folder):
    """The session as one of a cluster whose ``spark.checkpoint.dir`` is ``folder``."""
    from types import SimpleNamespace
    sc = spark.sparkContext
    monkeypatch.setattr(sc, "master", "spark://host:7077")
    monkeypatch.setattr(sc, "getConf", lambda: SimpleNamespace(
        get=lambda k, d=None: folder if k == "spark.checkpoint.dir" else d))


def test_file_checkpoint_folder_that_executors_see_is_used_on_a_cluster(spark, monkeypatch):
    from kasaflow.llm.common import written
    from kasaflow.plans.workspace import CashWorkspace
    from kasaflow.session import ensure_checkpoint_dir
    from kasaflow.sources.csv_source import read_cash_csv
    current = spark.sparkContext.getCheckpointDir()
    fact = cash_fact(spark, SF)
    want = sorted(map(tuple, fact.collect()))
    _as_cluster(monkeypatch, spark, os.path.dirname(current))
    assert ensure_checkpoint_dir(spark) == current
    assert written(spark.range(5), "cluster").count() == 5
    ws = CashWorkspace.from_fact(fact, "cluster")
    assert sorted(map(tuple, ws.fact.collect())) == want
    assert read_cash_csv(spark, ws.csv_path).count() == len(want)
    left = os.listdir(current.removeprefix("file:"))
    assert not any(name.startswith("kasaflow-shared-") for name in left)


def test_checkpoint_folder_without_whole_tables_is_refused_on_a_cluster(spark, monkeypatch, tmp_path):
    import pytest
    from kasaflow import session
    (tmp_path / "file").write_text("no folder")
    for folder in (f"file:{tmp_path}/file", "file:/proc/none"):
        with pytest.raises(RuntimeError, match="cannot see it"):
            session._require_shared(spark, folder)
    # a reader that finds fewer files than tasks wrote
    class Fewer:
        sparkContext = spark.sparkContext
        range = staticmethod(lambda lo, hi, step, n: spark.range(lo, hi - 1, step, n))
        read = spark.read
    with pytest.raises(RuntimeError, match="rows came back"):
        session._require_shared(Fewer, f"file:{tmp_path}/part")


def test_shuffle_join_fallback_equals_broadcast(spark):
    """Above the supplier bound the join is a sort-merge join; same rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = cash_fact(spark, SF, supplier_broadcast_rows=0)
        big.collect()
        plan = big._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        small = cash_fact(spark, SF)
        assert sorted(map(tuple, big.collect())) == sorted(map(tuple, small.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_daily_long_equals_pivot(spark):
    q = queries()
    piv = q["daily_pivot_nad_kz"](spark, SF).collect()
    long_rows = {(r.nazwa_kasy, r.data.isoformat()): r.value
                 for r in q["daily_long"](spark, SF).filter("measure = 'nad_kz'").collect()}
    from_pivot = {(r["nazwa_kasy"], k): v for r in piv for k, v in r.asDict().items()
                  if k != "nazwa_kasy" and v is not None}
    assert from_pivot == long_rows


def test_nation_level_binding_sums_to_region_level(spark):
    from pyspark.sql import functions as F
    nat = cash_fact(spark, SF, level="nation")
    reg = cash_fact(spark, SF)
    nations = spark.read.parquet(f"{SF}/supplier.parquet").select("s_nationkey").distinct().count()
    assert nat.select("nazwa_kasy").distinct().count() == nations
    tot = lambda df: df.agg(*[F.sum(F.col(m) * 100).cast("long").alias(m)
                              for m in ["zas_pl_R", "nad_kz", "zas_kz_W"]]).first()
    assert tot(nat) == tot(reg)


def test_csv_utf8_round_trip_of_weekday_names(spark, tmp_path):
    from kasaflow.sources.csv_source import read_cash_csv, write_cash_csv
    enriched = workspace(spark, SF).enriched.select("Data", "dzien")
    write_cash_csv(enriched, str(tmp_path / "days"))
    back = read_cash_csv(spark, str(tmp_path / "days"), schema=None, infer=True)
    names = {r.dzien for r in back.select("dzien").distinct().collect()}
    assert {"środa", "piątek", "poniedziałek", "niedziela"} <= names


def test_all_query_plans_stay_distributed(spark):
    """Every registered query: no row-at-a-time Python UDF, and no window or
    aggregate fed by a single-partition exchange (a final ORDER BY/LIMIT may
    gather to one partition; that is the feature)."""
    for name, fn in queries().items():
        plan = _plan(fn(spark, SF))
        assert "BatchEvalPython" not in plan, name
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line and "keys=[], functions=[partial_" not in lines[i + 1]:
                above = "\n".join(lines[max(0, i - 3):i])
                assert "Window" not in above and "HashAggregate" not in above, (name, above)


def test_intermediates_can_be_dropped_and_are_built_anew(spark):
    from kasaflow.session import drop_intermediates
    before = sorted(map(tuple, queries()["monthly_sums"](spark, SF).collect()))
    assert drop_intermediates(spark)
    assert sorted(map(tuple, queries()["monthly_sums"](spark, SF).collect())) == before
