"""The cash CSV is bound by its header; what cannot be read is kept apart."""

import gzip
import os
import shutil

import pytest

from kasaflow.operators.reports import monthly_sums
from kasaflow.plans.workspace import CashWorkspace, fingerprint
from kasaflow.sources.csv_source import (CASH_SCHEMA, bad_counts, bad_rows, header_names, read_cash_csv, scan_cash_csv)
from kasaflow.streaming.incremental import read_cash_stream, scan_cash_stream

HEADER = CASH_SCHEMA.names
ROWS = [("2024-01-%02d" % d, b, "D", *[f"{d}.{m}" for m in range(1, 7)]) for d in range(1, 9) for b in ("Houston", "Łódź")]


def write(folder, name, header, rows, opener=open):
    os.makedirs(folder, exist_ok=True)
    with opener(f"{folder}/{name}", "wt", encoding="utf-8") as f:
        f.write("\n".join(";".join(map(str, r)) for r in [header, *rows]) + "\n")


def in_order(rows, header, extra="?"):
    return [[dict(zip(HEADER, r)).get(c, extra) for c in header] for r in rows]


def fact(df):
    assert df.columns == HEADER and [f.dataType for f in df.schema] == [f.dataType for f in CASH_SCHEMA]
    return sorted(tuple(str(v) for v in r) for r in df.collect())


EXPECTED = sorted(tuple([*r[:3], *[str(float(v)) for v in r[3:]]]) for r in ROWS)
SHUFFLED = ["uwagi", "nad_kz", "zas_pl_R", "zas_kz_R", "nad_pl", "Data", "zas_kz_W", "dzien_wolny", "nazwa_kasy", "zas_pl_W"]


@pytest.mark.parametrize("header", [HEADER, SHUFFLED, [c.upper() for c in SHUFFLED], [f' "{c}" ' for c in SHUFFLED]])
def test_columns_are_bound_by_name(spark, tmp_path, header):
    write(tmp_path / "in", "a.csv", header, in_order(ROWS, [c.strip(' "') if '"' in c else c for c in header], "?")
          if header != [c.upper() for c in SHUFFLED] else in_order(ROWS, SHUFFLED))
    assert fact(read_cash_csv(spark, str(tmp_path / "in"))) == EXPECTED


def test_files_with_different_headers_folders_and_compression(spark, tmp_path):
    write(tmp_path / "in" / "y=1", "a.csv", HEADER, ROWS[:6])
    write(tmp_path / "in" / "y=2", "b.csv", SHUFFLED, in_order(ROWS[6:11], SHUFFLED))
    write(tmp_path / "in" / "y=2", "c.csv.gz", SHUFFLED[::-1], in_order(ROWS[11:], SHUFFLED[::-1]), gzip.open)
    write(tmp_path / "in" / "_tmp", "d.csv", ["x"], [["y"]])
    open(tmp_path / "in" / "empty.csv", "w").close()
    assert fact(read_cash_csv(spark, str(tmp_path / "in"))) == EXPECTED
    assert fact(read_cash_csv(spark, str(tmp_path / "in" / "y=*" / "*.csv*"))) == EXPECTED


def test_byte_order_mark_and_carriage_returns(spark, tmp_path):
    write(tmp_path, "a.csv", ["﻿" + HEADER[0], *HEADER[1:]], [[*r[:-1], r[-1] + "\r"] for r in ROWS])
    assert fact(read_cash_csv(spark, str(tmp_path / "a.csv"))) == EXPECTED


def test_missing_column_is_named(spark, tmp_path):
    short = [c for c in HEADER if c not in ("nad_pl", "Data")]
    write(tmp_path, "a.csv", short, in_order(ROWS, short))
    with pytest.raises(ValueError, match="no column Data, nad_pl"):
        read_cash_csv(spark, str(tmp_path / "a.csv"))
    with pytest.raises(ValueError, match="no CSV file"):
        read_cash_csv(spark, str(tmp_path / "absent"))


def test_header_names():
    assert header_names('a; "b;c" ;;A;"q""t"') == ["a", "b;c", "_c2", "_c3", 'q"t']
    assert header_names("") == []


BAD = [["2024-02-01", "Miami", "D", "x1", "2", "3", "4", "5", "6"],            # no number
       ["01.02.2024", "Miami", "D", "1", "2", "3", "4", "5", "6"],              # no ISO date
       ["2024-02-30", "Miami", "D", "1", "2", "3,5", "4", "5", "6"],            # no such day, decimal comma
       ["2024-02-03", "Miami", "D", "1", "2"],                                  # cells missing
       ["2024-02-04", "Miami", "D", "1", "2", "3", "4", "5", "6", "7"],         # a cell too many
       ["", "Miami", "D", "1", "2", "3", "4", "5", "6"],                        # no date
       ["2024-02-05", " ", "D", "1", "2", "3", "4", "5", "6"]]                  # no branch
EMPTY = ["2024-03-01", "Miami", "", "", "2", "", "4", "5", " 6 "]               # empty cells are NULL, not bad


def test_bad_rows_stop_the_read_or_go_to_the_quarantine(spark, tmp_path):
    write(tmp_path, "a.csv", HEADER, [*ROWS, *BAD, EMPTY])
    path = str(tmp_path / "a.csv")
    with pytest.raises(Exception, match="bad row in .*a.csv, columns"):
        read_cash_csv(spark, path).collect()
    good = read_cash_csv(spark, path, on_bad="quarantine")
    assert good.count() == len(ROWS) + 1
    one = good.where("Data = '2024-03-01'").first()
    assert one.dzien_wolny is None and one.zas_pl_R is None and one.zas_kz_R == 2.0 and one.zas_kz_W == 6.0
    bad = bad_rows(scan_cash_csv(spark, path))
    assert {r.cells.split('"Data":')[-1][:12] for r in bad.collect()} and bad.count() == len(BAD)
    assert all(r.file.endswith("a.csv") for r in bad.collect())
    counts = {r.reason: r.n_rows for r in bad_counts(bad).collect()}
    assert counts == {"zas_pl_R": 1, "Data": 2, "nad_pl": 1, "cells": 2, "no Data": 1, "no nazwa_kasy": 1}
    with pytest.raises(ValueError):
        read_cash_csv(spark, path, on_bad="ignore")


def test_workspace_keeps_the_quarantine_beside_the_reports(spark, tmp_path):
    write(tmp_path / "in", "a.csv", SHUFFLED, in_order(ROWS, SHUFFLED) + in_order(BAD[:1], SHUFFLED))
    ws = CashWorkspace.from_csv(spark, str(tmp_path / "in"), on_bad="quarantine")
    plain = CashWorkspace.from_fact(spark.createDataFrame([], CASH_SCHEMA).unionByName(
        read_cash_csv(spark, str(tmp_path / "in"), on_bad="quarantine")), "same")
    assert monthly_sums(ws.enriched).collect() == monthly_sums(plain.enriched).collect()
    assert [(r.reason, r.n_rows, r.n_files) for r in ws.rejected_counts.collect()] == [("zas_pl_R", 1, 1)]


def test_two_frames_of_one_name_do_not_touch_each_other(spark, tmp_path):
    write(tmp_path, "a.csv", HEADER, ROWS)
    rows = read_cash_csv(spark, str(tmp_path / "a.csv"))
    first = CashWorkspace.from_fact(rows.where("nazwa_kasy = 'Houston'"), "f").fact
    second = CashWorkspace.from_fact(rows, "f").fact
    assert first.count() == 8 and second.count() == 16


def test_fingerprint_sees_files_in_partition_folders(spark, tmp_path):
    write(tmp_path / "in" / "y=1", "a.csv", HEADER, ROWS)
    os.makedirs(tmp_path / "in" / "y=2")
    before = fingerprint(spark, [str(tmp_path / "in")])
    shutil.copy(tmp_path / "in" / "y=1" / "a.csv", tmp_path / "in" / "y=2" / "a.csv")
    assert fingerprint(spark, [str(tmp_path / "in")]) != before


def run(stream, name, tmp_path):
    q = (stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name))
         .trigger(availableNow=True).start())
    q.awaitTermination(200)
    return stream.sparkSession.table(name)


def test_stream_is_bound_by_header_too(spark, tmp_path):
    write(tmp_path / "in", "a.csv", SHUFFLED, in_order(ROWS[:8], SHUFFLED))
    write(tmp_path / "in", "b.csv", SHUFFLED, in_order(ROWS[8:], SHUFFLED))
    assert fact(run(read_cash_stream(spark, str(tmp_path / "in")), "by_header", tmp_path)) == EXPECTED


def test_stream_stops_at_another_header_and_sets_bad_rows_apart(spark, tmp_path):
    write(tmp_path / "in", "a.csv", HEADER, [*ROWS, *BAD[:3]])
    assert fact(run(read_cash_stream(spark, str(tmp_path / "in"), on_bad="quarantine"), "apart", tmp_path)) == EXPECTED
    bad = run(scan_cash_stream(spark, str(tmp_path / "in")).where("size(reasons) > 0").select("file", "reasons"), "bad", tmp_path)
    assert bad.count() == 3
    write(tmp_path / "in", "b.csv", SHUFFLED, in_order(ROWS, SHUFFLED))
    with pytest.raises(Exception):
        run(read_cash_stream(spark, str(tmp_path / "in"), header=HEADER), "other", tmp_path)
    with pytest.raises(ValueError, match="2 different headers"):
        read_cash_stream(spark, str(tmp_path / "in"))
