"""Every query with an oracle SQL equals DuckDB on sf0.001 (order-insensitive)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from oracle_check import TABLES, rows_of  # noqa: E402
from kasaflow.plans.catalog import queries  # noqa: E402
from kasaflow.plans.oracle import oracle_sql  # noqa: E402

SF = os.environ.get("KASAFLOW_TEST_SF", "/root/testdata/sf0.001")
NAMES = sorted(oracle_sql())
SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "float": "FLOAT", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_entry():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sdf = queries()[name](spark, SF)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(scols) == sorted(dcols)
    order = sorted(scols)
    assert rows_of(scols, srows, order) == rows_of(dcols, drows, order)
    # column types agree too (Spark simple type -> DuckDB type name)
    rel = con.sql(f"SELECT * FROM ({oracle_sql()[name]}) LIMIT 0")
    dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in sdf.dtypes} == dtypes
