"""The stored typed metrics: one table by month, made anew only when its inputs have changed.

All reads of a dashboard take their rows from it instead of rolling the log up again. A table
belongs to a state of its input files; it counts from its entry in `ready` on, so one that was only
half written is never read, and of two that were made at the same time all readers take the same.
Months are partitions and files are sorted by metric and day: a range prunes partitions, and metric,
source and days reach the Parquet scan, which skips row groups by them. Rows without a day are in a partition of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The partition column, which `reads.list_metrics` filters by too.
MONTH = "month"


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def inputs_state(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files under paths: names, lengths and times of change. No file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    one = files.select("path", "length", F.unix_micros("modificationTime").alias("at"))
    found = one.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.bit_xor(F.xxhash64("path", "length", "at")), F.bit_xor(F.xxhash64(F.lit(1), "path", "length", "at"))).first()
    return "-".join(f"{x or 0:x}" for x in found)


def write(metrics: DataFrame, path: str) -> None:
    """Typed metrics by month. Large months are split over tasks and small ones share one."""
    rows = metrics.withColumn(MONTH, month_of(F.col("day"))).hint("rebalance", F.col(MONTH))
    rows.sortWithinPartitions(MONTH, "metric_key", "day").write.partitionBy(MONTH).parquet(path)


def _made(spark: SparkSession, ready: str) -> str | None:
    try:
        return spark.read.schema("path string").parquet(ready).agg(F.min("path")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stored(spark: SparkSession, root: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table in root that belongs to the inputs as they are now; `build` gives its rows if there is none yet."""
    metrics = build()
    ready = f"{root}/ready/{inputs_state(spark, inputs)}"
    path = _made(spark, ready)
    if path is None:
        path = f"{root}/data/{uuid.uuid4().hex}"
        write(metrics, path)
        spark.createDataFrame([(path,)], "path string").write.mode("append").parquet(ready)
        path = _made(spark, ready)
    return spark.read.schema(T.StructType([*metrics.schema.fields, T.StructField(MONTH, T.StringType())])).parquet(path)
