"""Reads of the metrics table and the logs: filters, series, comparisons, top entries."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .warehouse import MONTH

RANGES = {"today": 1, "7d": 7, "30d": 30}


def date_range(key: str, as_of: str) -> tuple[date, date]:
    """The range's first and last day; unknown keys mean 30 days."""
    end = date.fromisoformat(as_of)
    return end - timedelta(days=RANGES.get(key, 30) - 1), end


def previous_range(start: date, end: date) -> tuple[date, date]:
    """The range of the same length that ends the day before."""
    return start - timedelta(days=(end - start).days + 1), start - timedelta(days=1)


def list_metrics(metrics: DataFrame, keys: list[str] | None = None, source_id: str | None = None, start: date | None = None, end: date | None = None, source_type: str | None = None) -> DataFrame:
    """Filtered metric rows; no keys means all. Filters reach a Parquet scan, and of a table by month a range takes its months only."""
    if MONTH in metrics.columns:
        low, high = (d and d.isoformat()[:7] for d in (start, end))
        metrics = metrics.where(F.col(MONTH) >= low) if low else metrics
        metrics = metrics.where(F.col(MONTH) <= high) if high else metrics
    if source_type is not None:
        metrics = metrics.where(F.col("source_type_key") == source_type)
    if keys:
        metrics = metrics.where(F.col("metric_key").isin(keys))
    if source_id is not None:
        metrics = metrics.where(F.col("source_id") == source_id)
    if start is not None:
        metrics = metrics.where(F.col("day") >= F.lit(start))
    if end is not None:
        metrics = metrics.where(F.col("day") <= F.lit(end))
    return metrics


def in_order(metrics: DataFrame) -> DataFrame:
    """Metric rows by day, then metric; the rest of the key breaks ties."""
    return metrics.orderBy("day", "metric_key", "source_id", "dimensions")


def with_dimensions(metrics: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows that have every wanted dimension with that value."""
    for k, v in wanted.items():
        metrics = metrics.where(F.get_json_object("dimensions", f"$.{k}").eqNullSafe(v))
    return metrics


def total(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.coalesce(F.sum("metric_value"), F.lit(0.0)).alias("metric_value"))


def calendar(metrics: DataFrame, start: date, end: date) -> DataFrame:
    days = metrics.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))
    return days


def dense_series(metrics: DataFrame, key: str, start: date, end: date) -> DataFrame:
    """One row for each day of the range: the metric's sum, or 0."""
    sums = list_metrics(metrics, [key], None, start, end).groupBy("day").agg(F.sum("metric_value").alias("v"))
    return calendar(metrics, start, end).join(sums, "day", "left").select("day", F.coalesce("v", F.lit(0.0)).alias("metric_value"))


def delta(current: Column, previous: Column) -> Column:
    """Change in per cent: from 0 to 0 is 0, from 0 to more has none."""
    return F.when(previous == 0, F.when(current == 0, 0.0)).otherwise((current - previous) / F.nullif(previous, F.lit(0.0)) * 100)


def period_delta(metrics: DataFrame, keys: list[str], start: date, end: date) -> DataFrame:
    """Sums of this and the previous period and the change, from one scan of both."""
    before = previous_range(start, end)
    rows = list_metrics(metrics, keys, None, before[0], end)
    now = F.col("day") >= F.lit(start)
    sums = rows.groupBy("metric_key").agg(F.coalesce(F.sum(F.when(now, F.col("metric_value"))), F.lit(0.0)).alias("current_value"), F.coalesce(F.sum(F.when(~now, F.col("metric_value"))), F.lit(0.0)).alias("previous_value"))
    return sums.withColumn("delta_percent", F.round(delta(F.col("current_value"), F.col("previous_value")), 6))


def latest(metrics: DataFrame) -> DataFrame:
    """The value of each metric's last day (ties: the greatest source and dimensions)."""
    return metrics.groupBy("metric_key").agg(F.max_by("metric_value", F.struct("day", F.coalesce("source_id", F.lit("")), "dimensions")).alias("metric_value"))


def by_mode(metrics: DataFrame, modes: DataFrame) -> DataFrame:
    """modes: metric_key, mode. A sum or the latest value of each metric, 0 where there is none."""
    both = metrics.groupBy("metric_key").agg(F.sum("metric_value").alias("s"), F.max_by("metric_value", F.struct("day", F.coalesce("source_id", F.lit("")), "dimensions")).alias("l"))
    value = F.when(F.col("mode") == "latest", F.col("l")).otherwise(F.col("s"))
    return modes.join(both, "metric_key", "left").select("metric_key", "mode", F.coalesce(value, F.lit(0.0)).alias("metric_value"))


def trend_both(series: DataFrame) -> DataFrame:
    """Heights of several series, each on its own scale (y_own) and all on one (y_shared)."""
    point = lambda base, span, top: F.round(base - F.col("metric_value") / F.greatest(top, F.lit(1.0)) * span, 4)
    own = series.withColumn("own", F.max("metric_value").over(W.partitionBy("metric_key")))
    return own.select("metric_key", "day", point(92, 78, F.col("own")).alias("y_own"), point(90, 76, F.max("own").over(W.partitionBy())).alias("y_shared"))


def source_comparison(metrics: DataFrame) -> DataFrame:
    """Page views, signups and custom events side by side for each source."""
    sums = [F.coalesce(F.sum(F.when(F.col("metric_key") == k, F.col("metric_value"))), F.lit(0.0)).alias(k) for k in ("page_views", "signups", "custom_events")]
    return metrics.groupBy(F.coalesce("source_id", F.lit("none")).alias("source")).agg(*sums)


def newest(events: DataFrame, n: int) -> DataFrame:
    """The newest n events, a top-k without a full sort."""
    return events.orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(n)


def top_entry(events: DataFrame, column: str, fallback: str, sample: int = 2000) -> DataFrame:
    """The most frequent value among the newest `sample` events; of equals the one seen last."""
    label = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(fallback))
    counts = newest(events, sample).groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.max(F.struct("occurred_at", "event_id")).alias("last"))
    return counts.orderBy(F.desc("n"), F.desc("last")).limit(1).select("label", "n")


def sparkline(series: DataFrame, partition: list[str]) -> DataFrame:
    """Points of a line in a 100 by 100 box; the scale holds 0 and at least 1."""
    all_ = W.partitionBy(*partition)
    low, high = F.least(F.min("metric_value").over(all_), F.lit(0.0)), F.greatest(F.max("metric_value").over(all_), F.lit(1.0))
    at, last = F.row_number().over(all_.orderBy("day")) - 1, F.count("*").over(all_) - 1
    y = 82 - (F.col("metric_value") - low) / F.greatest(high - low, F.lit(1.0)) * 64
    x = F.when(last == 0, 0.0).otherwise(at / F.nullif(last, F.lit(0)) * 100)
    return series.select(*partition, "day", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


def trend(series: DataFrame, shared: bool) -> DataFrame:
    """Heights of one series (own scale) or of several on one scale."""
    top = F.max("metric_value").over(W.partitionBy() if shared else W.partitionBy("metric_key"))
    base, span = (90, 76) if shared else (92, 78)
    return series.select("metric_key", "day", F.round(base - F.col("metric_value") / F.greatest(top, F.lit(1.0)) * span, 4).alias("y"))
