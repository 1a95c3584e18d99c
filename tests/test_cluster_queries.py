"""Queries run as on a cluster whose ``spark.checkpoint.dir`` is a shared ``file:`` folder: they end, with the rows of their SQL."""

import datetime as dt
import os
import random
import sys
from types import SimpleNamespace

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as E  # noqa: E402
from oracle_check import rows_of  # noqa: E402

NAMES = [
    "op1_sharding",
    "op4_mixing",
    "op7_topk",
    "op9_ngram_join",
    "op11_spelling",
    "op12_line_dedup",
    "op13_lexical",
    "acf",
    "acf_bounds",
    "adf_gram",
    "adf_test",
    "branch_month_detail",
    "calendar_distinct",
    "calendar_head",
    "csv_scan",
    "csv_scan_checked",
    "csv_rejected",
    "calendar_next_flag",
    "csv_scan_inferred",
    "daily_pivot_nad_pl",
    "daily_pivot_nad_kz",
    "daily_long",
    "daily_pivot_top5",
    "daily_pivot_top5_zas_pl_r",
    "daily_pivot_top5_zas_kz_r",
    "daily_pivot_top5_nad_pl",
    "daily_pivot_top5_zas_kz_w",
    "daily_pivot_top5_zas_pl_w",
    "daily_pivot_zas_pl_w",
    "daily_pivot_zas_kz_r",
]


def _texts():
    line = "Please read the terms of this site before use"
    words = ["harbour", "harbours", "market", "markets", "winter", "wintre", "signal", "signals", "garden", "gardens"]
    out = []
    for i in range(24):
        body = " ".join(words[(i * k) % 10] + ("" if (i + k) % 3 else f" item{k}") for k in range(1, 40))
        out.append(f"{line}\n{body}" if i % 2 else body)
    return [*out, out[3], out[3] + " end", None, "", "two words", "  \n\n x"]


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """Small tables of the given schema, and DuckDB views of them."""
    folder = str(tmp_path_factory.mktemp("tables"))
    con = duckdb.connect()
    docs = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(_texts())]
    vecs = [(i, [round(((i * (j + 3)) % 17 - 8) / 9, 4) for j in range(8)] if i != 5 else None, i % 2) for i in range(120)]
    items = [(i, t) for i, t in enumerate(["harbour market item3", "WINTER signals", "nothing here", "garden"])]
    start, lines, rng = dt.datetime(1998, 4, 20), [], random.Random(7)
    for day in range(170):
        for k in range(24):
            lines.append((day * 24 + k, k, rng.randrange(9), 1, 1.0, rng.randrange(100_000, 9_000_000) / 100, 0.0, 0.0,
                          rng.choice("ANR"), rng.choice("FO"), start + dt.timedelta(days=day)))
    tables = {
        "documents": ("doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT", docs),
        "embeddings": ("vec_id BIGINT, embedding FLOAT[], label INTEGER", vecs),
        "benchmark": ("item_id BIGINT, text VARCHAR", items),
        "lineitem": ("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE,"
                     " l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP", lines),
        "supplier": ("s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE", [(i, f"S{i}", i % 7, 1.0) for i in range(9)]),
        "nation": ("n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER", [(i, f"NATION_{i}", i % 3) for i in range(7)]),
        "region": ("r_regionkey INTEGER, r_name VARCHAR", [(0, "AMERICA"), (1, "ASIA"), (2, "EUROPE")]),
    }
    for name, (schema, rows) in tables.items():
        con.execute(f"CREATE TABLE _{name} ({schema})")
        con.executemany(f"INSERT INTO _{name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        con.execute(f"COPY _{name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return folder, con


@pytest.mark.parametrize("name", NAMES)
def test_query_ends_on_a_cluster_with_a_file_checkpoint_folder(spark, made, monkeypatch, name):
    folder, con = made
    sc = spark.sparkContext
    shared = os.path.dirname(sc.getCheckpointDir())
    monkeypatch.setattr(sc, "master", "spark://host:7077")
    monkeypatch.setattr(sc, "getConf", lambda: SimpleNamespace(get=lambda k, d=None: shared if k == "spark.checkpoint.dir" else d))
    df = E.queries()[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    if name == "op1_sharding":  # SQL does not express it: every document once, slots without gaps, all bytes
        slots = sorted((r["shard"], r["slot"]) for r in (dict(zip(df.columns, g)) for g in got))
        assert sorted(g[df.columns.index("doc_id")] for g in got) == list(range(len(_texts())))
        assert all(slot == 0 or (shard, slot - 1) in slots for shard, slot in slots) and len(set(slots)) == len(slots)
        assert sum(g[df.columns.index("size")] for g in got) == sum(len((t or "").encode()) + 1 for t in _texts())
        return
    con.execute(f"CREATE OR REPLACE VIEW expected AS {E.oracle_sql()[name]}")
    res = con.execute("SELECT * FROM expected")
    cols, want, order = [d[0] for d in res.description], res.fetchall(), sorted(df.columns)
    assert sorted(cols) == order and want
    assert rows_of(df.columns, got, order) == rows_of(cols, want, order)
