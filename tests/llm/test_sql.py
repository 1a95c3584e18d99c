"""The operators that SQL can express equal their DuckDB statements."""

import duckdb
import pytest

from kasaflow.llm.catalog import oracle_sql, queries

DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def test_every_statement_has_a_query_and_all_operators_are_registered():
    names = set(queries())
    assert set(oracle_sql()) <= names and "pipeline" in names
    assert {n.split("_")[0] for n in names - {"pipeline"}} == {f"op{k}" for k in range(1, 14)}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, folder):
    sf = f"/root/testdata/{folder}"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    con.execute(f"CREATE VIEW expected AS {oracle_sql()[name]}")
    res = con.execute("SELECT * FROM expected")
    types = {d[0]: str(d[1]) for d in res.description}
    df = queries()[name](spark, sf)
    assert {c: DUCK[t] for c, t in df.dtypes} == types
    order = sorted(df.columns)
    at = [list(types).index(c) for c in order]
    want = sorted((tuple(r[i] for i in at) for r in res.fetchall()), key=repr)  # NULLs have no order of their own
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr) == want
