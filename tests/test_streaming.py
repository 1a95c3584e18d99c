import os
import tempfile

from kasaflow.operators.reports import monthly_sums
from kasaflow.plans.workspace import workspace
from kasaflow.streaming.incremental import enrich_stream, monthly_totals_stream, read_cash_stream

SF = "/root/testdata/sf0.001"


def test_stream_monthly_totals_equal_batch(spark):
    ws = workspace(spark, SF)
    folder = tempfile.mkdtemp(prefix="kasaflow-stream-in-")
    # one file per month, landing in date order (the fixture is small)
    pdf = ws.fact.toPandas()
    pdf["_m"] = pdf["Data"].map(lambda d: d.strftime("%Y-%m"))
    for i, (m, part) in enumerate(sorted(pdf.groupby("_m"), key=lambda t: t[0])):
        path = f"{folder}/{i:04d}-{m}.csv"
        part.drop(columns="_m").to_csv(path, sep=";", index=False)
        os.utime(path, (1_000_000 + i, 1_000_000 + i))
    stream = read_cash_stream(spark, folder, max_files_per_trigger=8)
    out = monthly_totals_stream(enrich_stream(stream, ws.calendar, spark))
    q = (out.writeStream.format("memory").queryName("kasaflow_monthly").outputMode("update")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="kasaflow-stream-ck-"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    emitted = spark.sql("SELECT * FROM kasaflow_monthly").collect()
    got = {r["miesiac_rok"]: r for r in emitted}  # in the order of the batches: the last one holds
    batch = {r["miesiac_rok"]: r for r in monthly_sums(ws.enriched).collect()}
    assert {m: r.asDict() for m, r in got.items()} == {m: r.asDict() for m, r in batch.items()}


def test_late_rows_correct_their_month(spark):
    """A file of an early month that lands last changes that month's total; nothing is dropped."""
    ws = workspace(spark, SF)
    folder = tempfile.mkdtemp(prefix="kasaflow-stream-in-")
    pdf = ws.fact.toPandas()
    pdf["_m"] = pdf["Data"].map(lambda d: d.strftime("%Y-%m"))
    months = sorted(pdf["_m"].unique())[:3]
    parts = [pdf[pdf["_m"] == months[0]].iloc[:5], pdf[pdf["_m"] == months[2]], pdf[pdf["_m"] == months[0]].iloc[5:]]
    for i, part in enumerate(parts):
        part.drop(columns="_m").to_csv(f"{folder}/{i}.csv", sep=";", index=False)
        os.utime(f"{folder}/{i}.csv", (1_000_000 + i, 1_000_000 + i))
    out = monthly_totals_stream(enrich_stream(read_cash_stream(spark, folder, max_files_per_trigger=1), ws.calendar, spark))
    q = (out.writeStream.format("memory").queryName("kasaflow_late").outputMode("update")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="kasaflow-stream-ck-")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r["miesiac_rok"].strftime("%Y-%m"): r["suma_mc_nadmiary_od_kientaZ"] for r in spark.sql("SELECT * FROM kasaflow_late").collect()}
    assert got[months[0]] == round(pdf[pdf["_m"] == months[0]]["nad_kz"].sum(), 2)
