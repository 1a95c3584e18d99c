"""The notebook's native source: a ';'-separated CSV with a header row.

Columns are bound by the names in each file's header, never by position: a
file may have them in any order, with others between. A row that cannot be
read whole (a cell that is no date or number, too few or too many cells, no
date or branch) is never turned into NULLs in silence: it stops the read, or
goes to the quarantine with its file and reasons.

Empty cells are NULL. Files of one folder may have different headers; there is
one scan for each different header. A header without one of the fact's columns
is an error that names it.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kasaflow.functions.constants import MEASURES

CASH_SCHEMA = T.StructType(
    [T.StructField("Data", T.DateType()),
     T.StructField("nazwa_kasy", T.StringType()),
     T.StructField("dzien_wolny", T.StringType())]
    + [T.StructField(m, T.DoubleType()) for m in MEASURES]
)
REQUIRED = ("Data", "nazwa_kasy")
DATE_FORMAT = "yyyy-MM-dd"
HEADER_BYTES = 1 << 16
CORRUPT = "_corrupt_record"


# ---- headers ---------------------------------------------------------------------------------

def _files(spark: SparkSession, path: str) -> list:
    """Hadoop paths of the data files under a file, folder or glob (any store that Spark reads)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(conf)
    found = []
    for start in fs.globStatus(top) or []:
        if start.isFile():
            found.append(start.getPath())
            continue
        each = fs.listFiles(start.getPath(), True)
        while each.hasNext():
            one = each.next().getPath()
            below = str(one.toString())[len(str(start.getPath().toString())):]
            if not any(part.startswith(("_", ".")) for part in below.split("/") if part):
                found.append(one)
    return found


def _first_line(spark: SparkSession, path) -> str:
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    factory = spark.sparkContext._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(
        spark.sparkContext._jsc.hadoopConfiguration())
    codec = factory.getCodec(path)
    try:
        opened = codec.createInputStream(stream) if codec is not None else stream
        raw = bytes(opened.readNBytes(HEADER_BYTES))
    finally:
        stream.close()
    return raw.split(b"\n", 1)[0].decode("utf-8-sig", "replace").rstrip("\r")


def header_names(line: str, sep: str = ";") -> list[str]:
    """Column names of a header line, unquoted and trimmed; unnamed and repeated ones get names of their own."""
    names: list[str] = []
    for k, cell in enumerate(next(csv.reader([line], delimiter=sep, skipinitialspace=True), [])):
        name = cell.strip()
        taken = {n.lower() for n in names}
        names.append(name if name and name.lower() not in taken else f"_c{k}")
    return names


def headers(spark: SparkSession, path: str, sep: str = ";") -> dict[tuple[str, ...], list[str]]:
    """The different headers under ``path``, each with its files. Empty files have none."""
    found: dict[tuple[str, ...], list[str]] = {}
    for file in _files(spark, path):
        line = _first_line(spark, file)
        if line:
            found.setdefault(tuple(header_names(line, sep)), []).append(str(file.toString()))
    return found


def bound(names: tuple[str, ...] | list[str], schema: T.StructType = CASH_SCHEMA) -> dict[str, str]:
    """The header's name for each column of the schema (letter case aside)."""
    by_name = {n.lower(): n for n in names}
    missing = [f.name for f in schema if f.name.lower() not in by_name]
    if missing:
        raise ValueError(f"the header {';'.join(names)} has no column {', '.join(missing)}")
    return {f.name: by_name[f.name.lower()] for f in schema}


# ---- rows --------------------------------------------------------------------------------------

def _typed(cell: Column, kind: T.DataType, date_format: str) -> Column:
    cell = F.trim(cell)
    if isinstance(kind, T.DateType):
        return F.try_to_timestamp(cell, F.lit(date_format)).cast("date")
    return cell if isinstance(kind, T.StringType) else cell.try_cast(kind)


def checked(raw: DataFrame, names: dict[str, str], schema: T.StructType = CASH_SCHEMA,
            date_format: str = DATE_FORMAT) -> DataFrame:
    """Typed columns of the schema plus ``reasons`` (empty for a good row) from rows of text cells."""
    empty = {f.name: F.coalesce(F.trim(F.col(f"`{names[f.name]}`")), F.lit("")) == "" for f in schema}
    typed = {f.name: F.when(~empty[f.name], _typed(F.col(f"`{names[f.name]}`"), f.dataType, date_format)) for f in schema}
    reasons = [F.when(F.col(CORRUPT).isNotNull(), F.lit("cells"))]
    reasons += [F.when(~empty[f.name] & typed[f.name].isNull(), F.lit(f.name)) for f in schema]
    reasons += [F.when(empty[c], F.lit(f"no {c}")) for c in REQUIRED if c in names]
    return raw.select(*[typed[f.name].alias(f.name) for f in schema], F.array_compact(F.array(*reasons)).alias("reasons"),
                      F.col(CORRUPT).alias("line"), F.struct(*[f"`{n}`" for n in names.values()]).alias("cells"),
                      F.col("_metadata.file_path").alias("file"))


def _text_reader(reader, names, sep: str):
    cells = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(CORRUPT, T.StringType())])
    return (reader.schema(cells).option("header", "true").option("sep", sep).option("encoding", "UTF-8")
            .option("enforceSchema", "true").option("columnNameOfCorruptRecord", CORRUPT))


def scan_cash_csv(spark: SparkSession, path: str, schema: T.StructType = CASH_SCHEMA, sep: str = ";",
                  date_format: str = DATE_FORMAT) -> DataFrame:
    """Every data row: the schema's columns, ``reasons``, ``line``, ``cells`` (as JSON text) and ``file``."""
    parts = []
    for names, files in headers(spark, path, sep).items():
        raw = _text_reader(spark.read, names, sep).csv(files)
        part = checked(raw, bound(names, schema), schema, date_format)
        parts.append(part.withColumn("cells", F.to_json("cells")))
    if not parts:
        raise ValueError(f"no CSV file with a header under {path}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def good_rows(scan: DataFrame, schema: T.StructType = CASH_SCHEMA, on_bad: str = "fail") -> DataFrame:
    """The schema's columns of the good rows; a bad row stops the read unless ``on_bad`` is 'quarantine'."""
    bad = F.size("reasons") > 0
    if on_bad == "fail":
        told = F.concat(F.lit("bad row in "), F.col("file"), F.lit(", columns "), F.array_join("reasons", ", "), F.lit(": "), F.col("cells"))
        scan = scan.where(F.when(bad, F.raise_error(told).cast("boolean")).otherwise(F.lit(True)))
    elif on_bad == "quarantine":
        scan = scan.where(~bad)
    else:
        raise ValueError("on_bad is 'fail' or 'quarantine'")
    return scan.select(*schema.names)


def bad_rows(scan: DataFrame) -> DataFrame:
    """The quarantine: (file, reasons, cells, line) of every row that could not be read whole."""
    return scan.where(F.size("reasons") > 0).select("file", "reasons", "cells", "line")


def bad_counts(bad: DataFrame) -> DataFrame:
    """(reason, n_rows, n_files) of a quarantine; a row with several reasons counts for each."""
    return (bad.select("file", F.explode("reasons").alias("reason")).groupBy("reason")
            .agg(F.count("*").alias("n_rows"), F.count_distinct("file").alias("n_files")))


def read_cash_csv(spark: SparkSession, path: str, schema: T.StructType | None = CASH_SCHEMA,
                  infer: bool = False, on_bad: str = "fail", sep: str = ";", date_format: str = DATE_FORMAT) -> DataFrame:
    """Read the daily cash CSV by its header.

    An explicit schema is the default: inference costs an extra pass over the
    file and types measures as int or double depending on the data. Pass
    ``schema=None, infer=True`` for the notebook's behaviour.
    """
    if schema is None or infer:
        return (spark.read.option("header", "true").option("sep", sep).option("encoding", "UTF-8")
                .option("enforceSchema", "false").option("inferSchema", "true").csv(path))
    return good_rows(scan_cash_csv(spark, path, schema, sep, date_format), schema, on_bad)


def write_cash_csv(df: DataFrame, path: str) -> None:
    """Write a fact in the same format (header, ';', UTF-8, ISO dates)."""
    (df.write.mode("overwrite").option("header", "true").option("sep", ";")
     .option("encoding", "UTF-8").option("dateFormat", "yyyy-MM-dd").csv(path))
