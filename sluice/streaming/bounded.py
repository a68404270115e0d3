"""Streams whose state is bounded by a watermark, for logs too large to look every identity up.

The watermark is the latest time seen, less the lateness allowed. Rows at or before it are dropped, and what it has
passed leaves the state: windows are given when their end is passed (append mode), identities are
forgotten. With a lateness of a day or more, an identity that is forgotten can't count twice in its day,
as a later row of that day is behind the watermark by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def day_windows(events: DataFrame, lateness: str) -> DataFrame:
    """Counts by day, source and event of the rows that are not late; a day is given when the watermark has passed it."""
    rows = events.withColumn("at", F.col("occurred_at").cast("timestamp")).withWatermark("at", lateness)
    return rows.groupBy(F.window("at", "1 day").alias("w"), "source_id", "event_name").count().select(F.to_date("w.start").alias("day"), "source_id", "event_name", "count")


def first_of_day(events: DataFrame, identity: str, lateness: str) -> DataFrame:
    """Of each identity of a source and day the row that comes first, if it is not late."""
    rows = events.withColumn("at", F.col("occurred_at").cast("timestamp")).withWatermark("at", lateness)
    return rows.dropDuplicatesWithinWatermark(["source_id", "day", identity]).select("source_id", "day", identity)


def run(spark: SparkSession, input_dir: str, schema: T.StructType, state_dir: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Take the new files under input_dir, append what the transformation gives to a table and return it; a restart goes on."""
    stream = transform(spark.readStream.schema(schema).parquet(input_dir))
    out = stream.writeStream.format("parquet").outputMode("append").option("path", f"{state_dir}/out").option("checkpointLocation", f"{state_dir}/checkpoint")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{state_dir}/out")
