"""Session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins and coalesces shuffle
# partitions at run time and splits skewed join partitions; ANSI mode makes
# overflow and bad casts fail loudly instead of returning NULL.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Small CPU-heavy stages (per-series windows, Gram sums) keep several
    # tasks instead of being coalesced into one; large shuffles are still
    # sized by spark.sql.adaptive.advisoryPartitionSizeInBytes.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_or_create_session(master: str = "local[*]", shuffle_partitions: int = 8,
                          app_name: str = "kasaflow") -> SparkSession:
    """Session for tests and local runs. On a cluster use the cluster's session."""
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder for checkpoints and materialised tables.

    Taken from the session (``spark.checkpoint.dir`` or a directory already
    set on the context). Only a local-mode session with nothing configured
    gets a fresh temporary folder; a cluster session without one is an error,
    because a machine-local folder is not visible to other executors. A path
    such as ``file:/mnt/shared`` may be a mount of all machines or a folder of
    each: on a cluster it is tried out once per application, and refused if
    what tasks write there does not come back whole.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current and sc.master.startswith("local"):
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if configured.startswith(("file:", "/")) and not sc.master.startswith("local"):
            _require_shared(spark, current or configured)
        if not current:
            sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/DBFS)")
    folder = tempfile.mkdtemp(prefix="kasaflow-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


_SHARED: set[tuple[str, str]] = set()
_SHARED_LOCK = threading.Lock()


def _require_shared(spark: SparkSession, folder: str) -> None:
    """Raise unless a table that tasks write under ``folder`` is read back whole.

    One row and file a task, on as many tasks as there are cores. Where
    machines have folders of their own, the driver's commit does not find the
    files of other machines, or their tasks cannot read its files.
    """
    refused = f"spark.checkpoint.dir is {folder}: executors on other machines cannot see it"
    try:
        key = (spark.sparkContext.applicationId, folder)
        with _SHARED_LOCK:
            if key in _SHARED:
                return
            path = f"{folder.rstrip('/')}/kasaflow-shared-{uuid.uuid4().hex}"
            tasks = max(2, spark.sparkContext.defaultParallelism)
            spark.range(0, tasks, 1, tasks).write.parquet(path)
            rows = spark.read.schema("id long").parquet(path).count()
            tried = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            tried.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(tried, True)
            if rows == tasks:
                _SHARED.add(key)
                return
    except Exception as failed:  # whatever stops the trial would stop every stage that is written there
        raise RuntimeError(refused) from failed
    raise RuntimeError(f"{refused} ({rows} of {tasks} rows came back)")


def drop_intermediates(spark: SparkSession) -> bool:
    """Delete the application's own folder of checkpoints and written stages.

    Frames returned by queries read from it, so call this only when their
    results have been written or collected; later queries build their stages
    anew. Spark gives every application a folder of its own under
    ``spark.checkpoint.dir``; that folder alone is deleted.
    """
    from kasaflow.plans import workspace as stages
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    with stages._LOCK:
        stages._WORKSPACES.clear()
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = fs.delete(path, True)
    fs.mkdirs(path)
    return done


_SHIPPED: set[str] = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``kasaflow`` importable in Python workers (``applyInPandas`` and
    pandas UDF bodies are pickled by reference to this package).

    Zips the package once per application and adds it with ``addPyFile``, the
    same mechanism as ``--py-files``; Spark copies the archive to every
    executor.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    with _SHIP_LOCK:
        if app in _SHIPPED:
            return
        pkg_dir = os.path.dirname(os.path.abspath(__file__))
        root = os.path.dirname(pkg_dir)
        out_dir = tempfile.mkdtemp(prefix="kasaflow-pyfiles-")
        archive = os.path.join(out_dir, "kasaflow.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zf:
            for folder, _, files in os.walk(pkg_dir):
                if "__pycache__" in folder:
                    continue
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        zf.write(full, os.path.relpath(full, root))
        sc.addPyFile(archive)
        _SHIPPED.add(app)
