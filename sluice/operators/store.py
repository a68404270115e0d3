"""Sinks as DataFrame to DataFrame steps: landing, upsert, increment, patch, delete.

Keys are null-safe: rows with a null source are one source. Each step is a combining
aggregate by key over target and delta, so there is no per-row look-up. Where a table is
kept as Parquet, `overwrite_days` rewrites only the day partitions that the delta touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRIC_KEY = ["day", "source_id", "metric_key", "dimensions_hash"]


def land(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """batch (seq, source_id, payload_hash) with is_new: the first of its key, and not in existing."""
    key = ["source_id", "payload_hash"]
    first = batch.groupBy(*key).agg(F.min("seq").alias("first_seq"))
    known = existing.select(*key).distinct().withColumn("known", F.lit(True))
    state = first.join(known, [first[c].eqNullSafe(known[c]) for c in key], "left").select(first.source_id.alias("s"), first.payload_hash.alias("h"), "first_seq", "known")
    joined = batch.join(state, batch.source_id.eqNullSafe(F.col("s")) & batch.payload_hash.eqNullSafe(F.col("h")))
    return joined.withColumn("is_new", (F.col("seq") == F.col("first_seq")) & F.col("known").isNull()).select(*batch.columns, "is_new")


def once(rows: DataFrame, key: str, order: list[str], landed: DataFrame | None = None) -> DataFrame:
    """The first row of each key by order, without the keys of landed; rows with a null key all stay."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("v")).select("v.*")
    if landed is not None:
        first = first.join(landed.select(key), key, "left_anti")
    return rows.where(F.col(key).isNull()).unionByName(first)


def upsert(target: DataFrame, batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key wins; rows of the batch are later than all of the target."""
    columns = [c for c in target.columns if c not in key]
    rows = target.withColumn("_o", F.struct(F.lit(0).alias("b"), F.lit(0).cast("long").alias("o"))).unionByName(batch.withColumn("_o", F.struct(F.lit(1).alias("b"), F.col(order).cast("long").alias("o"))).select(*target.columns, "_o"))
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*columns), "_o").alias("v"))
    return last.select(*[c if c in key else F.col(f"v.{c}").alias(c) for c in target.columns])


def increment(target: DataFrame, delta: DataFrame, key: list[str] = METRIC_KEY) -> DataFrame:
    """Values add up; the other columns are the newest row's."""
    columns = [c for c in target.columns if c not in key and c != "metric_value"]
    rows = target.withColumn("_o", F.lit(0)).unionByName(delta.select(*target.columns).withColumn("_o", F.lit(1)))
    out = rows.groupBy(*key).agg(F.sum("metric_value").alias("metric_value"), *([F.max_by(F.struct(*columns), "_o").alias("v")] if columns else []))
    return out.select(*[F.col(f"v.{c}").alias(c) if c in columns else c for c in target.columns])


def overwrite_days(merged: DataFrame, path: str) -> None:
    """Rewrite the day partitions that merged holds, and no others."""
    merged.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def patch(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with changes (key, column, value) applied; a null value is set, a column without change stays."""
    columns = [c for c in rows.columns if c != key]
    wide = changes.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("_c"))
    joined = rows.join(wide, key, "left")
    new = [F.when(F.coalesce(F.map_contains_key("_c", F.lit(c)), F.lit(False)), F.col("_c")[c].cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in columns]
    return joined.select(key, *new).select(*rows.columns)


def delete_source(children: DataFrame, gone: DataFrame, cascade: bool) -> DataFrame:
    """Children of deleted sources go (cascade) or lose their source."""
    gone = gone.select(F.col("id").alias("gone_id"))
    if cascade:
        return children.join(gone, F.col("source_id") == F.col("gone_id"), "left_anti")
    joined = children.join(gone, F.col("source_id") == F.col("gone_id"), "left")
    return joined.withColumn("source_id", F.when(F.col("gone_id").isNull(), F.col("source_id"))).drop("gone_id")
