"""Write PLANS.md: final (post-AQE) physical plans of representative queries.

usage: python tools/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kasaflow.plans.catalog import queries  # noqa: E402
from kasaflow.session import get_or_create_session  # noqa: E402
from kasaflow.sources.binding import cash_fact  # noqa: E402

SHOW = ["monthly_sums", "branch_month_detail", "deadline_calendar", "deadline_enrich", "acf",
        "adf_test", "forecast_seasonal_ma", "forecast_metrics"]


def final_plan(df, width: int = 170) -> str:
    df.collect()  # runs this DataFrame's own query execution, so AQE finalises its plan
    text = df._jdf.queryExecution().executedPlan().toString()
    return "\n".join(line if len(line) <= width else line[:width] + " ..." for line in text.splitlines())


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_or_create_session("local[4]")
    out = ["# Physical plans", "",
           f"Generated by `python tools/explain_plans.py {sf_dir}` (final adaptive plans after the",
           "query ran; long lines cut).", ""]
    fact = cash_fact(spark, sf_dir, start="1998-07-01", end="1998-08-01")
    text = formatted(fact)
    scans = [b for b in text.split("\n\n") if b.lstrip().startswith("(") and "Scan parquet" in b]
    out += ["## Fact binding, one month (`cash_fact(start, end)`)", "", "```",
            final_plan(fact), "```", "", "Scan details:", "", "```", "\n\n".join(scans).strip(), "```", ""]
    for name in SHOW:
        df = queries()[name](spark, sf_dir)
        out += [f"## `{name}`", "", "```", final_plan(df), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
