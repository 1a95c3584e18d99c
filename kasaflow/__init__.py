"""kasaflow: daily branch cash-flow analytics as Spark DataFrame jobs.

Layout
------
sources/    fact readers (CSV, the TPC-H binding), the weekday dimension
functions/  column-level helpers (calendar rule, formatting, statistics)
operators/  DataFrame -> DataFrame stages (enrichment, deadline calendar,
            reports, time-series core, diagnostics, forecasts)
plans/      materialised workspace and the query catalogue
streaming/  the same enrichment applied to a file stream
"""

from kasaflow.session import ensure_checkpoint_dir, get_or_create_session

__all__ = ["ensure_checkpoint_dir", "get_or_create_session"]
