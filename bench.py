"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

``end_to_end`` (beside ``queries``, not in the total) is the time of a query
from the source tables on, with nothing materialised before.
``workspace_build`` is the one pass over the source tables that materialises
the enriched daily fact (fact + calendar + enrichment) and the split daily
series to the checkpoint folder; every run builds fresh tables. Every other
query writes its whole result to the ``noop`` sink, so all rows are computed.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kasaflow.plans.catalog import queries  # noqa: E402
from kasaflow.plans.workspace import _WORKSPACES, CashWorkspace, workspace  # noqa: E402
from kasaflow.session import get_or_create_session  # noqa: E402

HEADLINE = [
    "monthly_sums", "monthly_report", "monthly_pivot_nad_kz", "daily_pivot_nad_kz", "daily_long",
    "branch_month_detail", "deadline_calendar", "deadline_enrich", "series_by_deadline",
    "series_diff", "train_test_split", "diff_histogram", "measure_correlation", "acf", "pacf",
    "adf_test", "forecast_seasonal_ma", "forecast_metrics", "ljung_box", "forecast_compare",
    "forecast_lag_regression", "order_search",
]

END_TO_END = ["monthly_report", "deadline_enrich", "diff_histogram", "adf_test", "forecast_seasonal_ma",
              "forecast_lag_regression", "order_search"]


def run_noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "3")))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = get_or_create_session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    qs = queries()
    times: dict[str, float] = {}

    def build(ws: CashWorkspace) -> None:
        ws.enriched  # fact -> calendar -> enriched, each written once
        ws.series    # daily series of every (branch, measure), split

    samples = []
    for i in range(repeat + 1):  # fresh tables each time; the first run is the warm-up
        fresh = CashWorkspace(spark, sf_dir)
        fresh._tag = f"{fresh._tag}-bench{i}"
        t = time.perf_counter()
        build(fresh)
        if i:
            samples.append(time.perf_counter() - t)
    times["workspace_build"] = round(statistics.median(samples), 3)
    build(workspace(spark, sf_dir))  # the memoised workspace the queries read

    errors: dict[str, str] = {}
    for name in HEADLINE:
        if name not in qs:
            continue
        try:
            run_noop(qs[name](spark, sf_dir))  # warm-up
            samples = []
            for _ in range(repeat):
                t = time.perf_counter()
                run_noop(qs[name](spark, sf_dir))
                samples.append(time.perf_counter() - t)
            times[name] = round(statistics.median(samples), 3)
        except Exception as exc:  # noqa: BLE001 - report and keep measuring the rest
            errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"

    # From the source tables on: every stage a query needs is built anew.
    end_to_end: dict[str, float] = {}
    for name in END_TO_END:
        _WORKSPACES.clear()
        salt = CashWorkspace(spark, sf_dir)
        key = (spark.sparkContext.applicationId, salt._tag)
        salt._tag = f"{salt._tag}-{name}"
        _WORKSPACES[key] = salt
        t = time.perf_counter()
        run_noop(qs[name](spark, sf_dir))
        end_to_end[name] = round(time.perf_counter() - t, 3)

    total = round(sum(times.values()), 3)
    result = {"metric": "total_sec", "value": total, "unit": "sec", "queries": times,
              "end_to_end": end_to_end, "sf": sf, "cpus": int(cpus), "repeat": repeat}
    if errors:
        result["errors"] = errors
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
