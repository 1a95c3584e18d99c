"""Published reports: one copy of every batch, whatever happened before; stored series need no shuffle."""

import os

import pytest
from pyspark.sql import functions as F

from kasaflow.operators import diagnostics as D
from kasaflow.operators import series as S
from kasaflow.plans.publish import COMMITS, commits, committed, publish, publish_stream, published
from kasaflow.plans.workspace import workspace

SF = "/root/testdata/sf0.001"


def report(spark, months, value):
    return spark.createDataFrame([(m, b, float(value)) for m in months for b in ("Houston", "Miami")], "m string, b string, v double")


def rows(spark, folder):
    return sorted((r.m, r.b, r.v) for r in published(spark, folder).collect())


def test_a_batch_replaces_its_partitions_once(spark, tmp_path):
    folder = str(tmp_path / "r")
    with pytest.raises(ValueError, match="nothing was committed"):
        published(spark, folder)
    assert publish(report(spark, ["2024-01", "2024-02"], 1), folder, ["m"], "first")
    assert not publish(report(spark, ["2024-01", "2024-02"], 9), folder, ["m"], "first")  # there already
    assert publish(report(spark, ["2024-02", "2024-03"], 2), folder, ["m"], "second")
    assert rows(spark, folder) == [(m, b, v) for m, v in (("2024-01", 1.0), ("2024-02", 2.0), ("2024-03", 2.0)) for b in ("Houston", "Miami")]
    assert set(commits(spark, folder)) == {"first", "second"} and commits(spark, folder)["first"]["partitioned_by"] == ["m"]


def test_a_write_that_fails_leaves_no_marker_and_its_repetition_one_copy(spark, tmp_path):
    folder = str(tmp_path / "r")
    publish(report(spark, ["2024-01"], 1), folder, ["m"], "first")
    broken = report(spark, ["2024-01", "2024-02"], 2).repartition(4).withColumn(
        "v", F.when((F.col("b") == "Miami") & (F.col("m") == "2024-02"), F.raise_error(F.lit("killed")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="killed"):
        publish(broken, folder, ["m"], "second")
    assert not committed(spark, folder, "second") and rows(spark, folder) == [("2024-01", b, 1.0) for b in ("Houston", "Miami")]
    for _ in range(2):
        publish(report(spark, ["2024-01", "2024-02"], 2), folder, ["m"], "second")
    assert rows(spark, folder) == [(m, b, 2.0) for m in ("2024-01", "2024-02") for b in ("Houston", "Miami")]


def test_a_write_stopped_before_its_marker_is_repeated(spark, tmp_path):
    folder = str(tmp_path / "r")
    publish(report(spark, ["2024-01"], 1), folder, ["m"], "first")
    os.rename(tmp_path / "r" / COMMITS / "first", tmp_path / "r" / COMMITS / "_first")  # as if killed before the rename
    assert publish(report(spark, ["2024-01"], 1), folder, ["m"], "first") and len(rows(spark, folder)) == 2


def test_empty_reports_nulls_and_names(spark, tmp_path):
    folder = str(tmp_path / "r")
    publish(report(spark, ["2024-01", None], 1), folder, ["m"], "first")
    publish(report(spark, [], 1), folder, ["m"], "nothing")
    assert published(spark, folder).where("m IS NULL").count() == 2 and published(spark, folder).count() == 4
    for name in ("", "a/b", "_x", ".x", "a*"):
        with pytest.raises(ValueError):
            publish(report(spark, [], 1), folder, ["m"], name)
    with pytest.raises(ValueError, match="at least one column"):
        publish(report(spark, [], 1), folder, [], "none")


def test_stream_batches_are_published_once(spark, tmp_path):
    folder, source = str(tmp_path / "r"), str(tmp_path / "in")
    report(spark, ["2024-01", "2024-02"], 3).write.parquet(source)
    stream = spark.readStream.schema("m string, b string, v double").parquet(source)
    for _ in range(2):  # the second run has lost its checkpoint and replays the batch
        q = (publish_stream(stream, folder, ["m"], "s").option("checkpointLocation", str(tmp_path / os.urandom(4).hex()))
             .trigger(availableNow=True).start())
        q.awaitTermination(100)
    assert len(rows(spark, folder)) == 4 and set(commits(spark, folder)) == {"s-0"}


@pytest.mark.parametrize("name", ["acf", "adf", "diff", "split", "histogram", "null_counts"])
def test_no_shuffle_over_the_stored_series(spark, name):
    table = workspace(spark, SF).series
    df = {"acf": lambda: S.acf(table), "adf": lambda: D.adf_test(table), "diff": lambda: S.series_diff(table.drop("diff")),
          "split": lambda: S.train_test_split(table.drop("rn", "n", "n_test", "split")),
          "histogram": lambda: S.diff_histogram(table), "null_counts": lambda: S.null_counts(S.train_series(table))}[name]()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Initial Plan")[0]
