"""Reports kept for later: partitioned Parquet with commit markers.

``publish`` replaces the partitions that a report has rows for (dynamic
partition overwrite: Spark writes aside and moves whole partitions when the
job commits) and then leaves a marker named by the batch. A batch that has its
marker is not written again; one that was stopped half-way has none, and its
repetition replaces the same partitions. So every batch is in the folder once,
however often it was tried. Markers are written aside and renamed, through
Hadoop's file system, so the folder may be in any store that Spark writes.

A report without rows replaces nothing; NULL partition values have a partition
of their own.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

COMMITS = "_commits"  # readers of the report skip names with a leading underscore


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _marker(folder: str, batch: str) -> str:
    if not batch or any(c in batch for c in "/\\:*?[]{}") or batch.startswith((".", "_")):
        raise ValueError(f"{batch!r} is no name for a batch")
    return f"{folder.rstrip('/')}/{COMMITS}/{batch}"


def committed(spark: SparkSession, folder: str, batch: str) -> bool:
    fs, path = _fs(spark, folder)
    return fs.exists(path(_marker(folder, batch)))


def commits(spark: SparkSession, folder: str) -> dict[str, dict]:
    """What each committed batch says of itself."""
    fs, path = _fs(spark, folder)
    at = path(f"{folder.rstrip('/')}/{COMMITS}")
    if not fs.exists(at):
        return {}
    found = {}
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if not name.startswith((".", "_")):
            stream = fs.open(status.getPath())
            try:
                found[name] = json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
            finally:
                stream.close()
    return found


def publish(df: DataFrame, folder: str, partition_by: list[str], batch: str) -> bool:
    """Put the rows of ``df`` in place of its partitions in ``folder``; False if the batch was there already."""
    spark = df.sparkSession
    if committed(spark, folder, batch):
        return False
    if not partition_by:
        raise ValueError("a report is partitioned by at least one column")
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(folder))
    fs, path = _fs(spark, folder)
    done = path(_marker(folder, batch))
    aside = path(f"{folder.rstrip('/')}/{COMMITS}/_{batch}")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(json.dumps({"partitioned_by": partition_by, "columns": df.columns}).encode("utf-8")))
    finally:
        stream.close()
    if not fs.rename(aside, done) and not fs.exists(done):
        raise RuntimeError(f"the marker {done} could not be put in place")
    return True


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all committed batches; an error if there is none."""
    if not commits(spark, folder):
        raise ValueError(f"nothing was committed in {folder}")
    return spark.read.parquet(folder)


def publish_stream(stream: DataFrame, folder: str, partition_by: list[str], name: str):
    """A writer whose micro-batches are published under their number: a batch that is replayed after a failure
    replaces itself. For streams whose batches hold whole partitions (update mode of totals by month, say)."""
    return stream.writeStream.foreachBatch(lambda df, n: publish(df, folder, partition_by, f"{name}-{n}") and None)
