"""Literal dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from kasaflow.functions.constants import WEEKDAYS

WEEKDAY_SCHEMA = T.StructType([T.StructField("id", T.LongType(), False),
                               T.StructField("dzien", T.StringType(), False)])


def weekday_dim(spark: SparkSession) -> DataFrame:
    """(id, dzien): 7 rows, Sunday = 1. Fixed size, so always safe to broadcast."""
    return spark.createDataFrame(WEEKDAYS, WEEKDAY_SCHEMA)
