"""The typed metrics table and the dashboard's module records.

A typed row also has its source's kind and the metric's unit. Module records read it once
for both periods: rows are summed by (kind, source, metric), which leaves one row for each
of these, and only those meet the modules' configuration.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import reads
from .sync import WEB_KINDS, web_sources

#: Each module's metrics as (key, unit, mode), the main one first.
METRICS = {
    "website": [("unique_visitors", "count", "sum"), ("page_views", "count", "sum"), ("sessions", "count", "sum"), ("custom_events", "count", "sum")],
    "supabase": [("signups", "count", "sum"), ("users_total", "count", "latest"), ("confirmed_users", "count", "latest"), ("signups_by_provider", "count", "sum")],
    "tiktok": [("video_views", "count", "sum"), ("likes", "count", "sum"), ("comments", "count", "sum"), ("shares", "count", "sum"), ("engagement_rate", "percent", "latest")],
    "instagram": [("reach", "count", "sum"), ("impressions", "count", "sum"), ("followers", "count", "latest"), ("profile_views", "count", "sum"), ("engagement_rate", "percent", "latest")],
    "shopify": [("orders", "count", "sum"), ("net_payment", "usd", "sum"), ("gross_sales", "usd", "sum"), ("refunds", "usd", "sum")],
    "custom_api": [("records_fetched", "count", "sum"), ("records_inserted", "count", "sum"), ("records_updated", "count", "sum")],
    "custom_csv": [("rows_imported", "count", "sum"), ("files_processed", "count", "sum"), ("rows_rejected", "count", "sum")],
}
#: A module shows so many metrics besides its main one.
SECONDARY = 4
CONFIG_SCHEMA = "position int, module string, slot int, metric_key string, unit string, mode string"
CONFIG = [(p, m, s, *x) for p, (m, found) in enumerate(METRICS.items()) for s, x in enumerate(found[: SECONDARY + 1])]
UNITS = {k: u for found in METRICS.values() for k, u, _ in found}
#: The modules whose series the dashboard draws, in this order.
SERIES = ["website", "supabase", "tiktok", "instagram"]


def typed(metrics: DataFrame, sources: DataFrame) -> DataFrame:
    """metrics with source_type_key (of its source) and unit."""
    kinds = sources.select(F.col("id").alias("source_id"), F.col("type_key").alias("source_type_key"))
    unit = F.when(F.col("metric_key").isin([k for k, u in UNITS.items() if u == "percent"]), "percent").when(F.col("metric_key").isin([k for k, u in UNITS.items() if u == "usd"]), "usd").otherwise("count")
    return metrics.join(F.broadcast(kinds), "source_id", "left").withColumn("unit", unit)


def chosen_sources(sources: DataFrame) -> DataFrame:
    """The source of each module that has one, in a column module; of several the first by name, of web sources the primary one."""
    web = web_sources(sources).where("is_primary").drop("is_primary").withColumn("module", F.lit("website"))
    others = sources.where(~F.col("type_key").isin(WEB_KINDS)).withColumn("n", F.row_number().over(W.partitionBy("type_key").orderBy("display_name"))).where("n = 1").drop("n")
    return web.unionByName(others.withColumn("module", F.col("type_key")))


def module_values(metrics: DataFrame, sources: DataFrame, start: date, end: date) -> DataFrame:
    """position, module, slot, source_id, metric_key, unit, value, previous_value of each module's metrics.

    metrics: typed. A module without a source takes the rows of its kind of all sources.
    previous_value: of the period before, for the main metric (slot 0) only.
    """
    before = reads.previous_range(start, end)
    rows = reads.list_metrics(metrics, sorted(UNITS), None, before[0], end)
    now = F.col("day") >= F.lit(start)
    of = lambda c: F.when(c, F.col("metric_value"))
    newest = F.when(now, F.struct("day", F.coalesce("source_id", F.lit("")).alias("s"), "dimensions", "metric_value"))
    sums = rows.groupBy("source_type_key", "source_id", "metric_key").agg(F.sum(of(now)).alias("s"), F.sum(of(~now)).alias("p"), F.max(newest).alias("l"))
    config = metrics.sparkSession.createDataFrame(CONFIG, CONFIG_SCHEMA)
    mine = chosen_sources(sources).select("module", F.col("id").alias("own_id"), F.col("type_key").alias("kind"))
    config = config.join(F.broadcast(mine), "module", "left").withColumn("kind", F.coalesce("kind", "module"))
    found = sums.withColumnRenamed("metric_key", "key").join(F.broadcast(config), (F.col("key") == F.col("metric_key")) & (F.col("source_type_key") == F.col("kind")) & (F.col("own_id").isNull() | (F.col("own_id") == F.col("source_id"))))
    values = found.groupBy("module", "metric_key").agg(F.sum("s").alias("s"), F.sum("p").alias("p"), F.max("l").alias("l"))
    value = F.when(F.col("mode") == "latest", F.col("l.metric_value")).otherwise(F.col("s"))
    previous = F.when(F.col("slot") == 0, F.coalesce("p", F.lit(0.0)))
    return config.join(values, ["module", "metric_key"], "left").select("position", "module", "slot", F.col("own_id").alias("source_id"), "metric_key", "unit", F.coalesce(value, F.lit(0.0)).alias("value"), previous.alias("previous_value"))


def module_series(metrics: DataFrame, sources: DataFrame, start: date, end: date) -> DataFrame:
    """position, module, day, value: the main metric of the modules in SERIES, with a row for each day."""
    main = metrics.sparkSession.createDataFrame([(k, m, METRICS[m][0][0]) for k, m in enumerate(SERIES)], "position int, module string, metric_key string")
    mine = chosen_sources(sources).select("module", F.col("id").alias("own_id"), F.col("type_key").alias("kind"))
    main = main.join(F.broadcast(mine), "module", "left").withColumn("kind", F.coalesce("kind", "module"))
    rows = reads.list_metrics(metrics, [METRICS[m][0][0] for m in SERIES], None, start, end).groupBy("day", "source_type_key", "source_id", "metric_key").agg(F.sum("metric_value").alias("v"))
    found = rows.withColumnRenamed("metric_key", "key").join(F.broadcast(main), (F.col("key") == F.col("metric_key")) & (F.col("source_type_key") == F.col("kind")) & (F.col("own_id").isNull() | (F.col("own_id") == F.col("source_id"))))
    sums = found.groupBy("module", "day").agg(F.sum("v").alias("v"))
    days = main.select("position", "module", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))
    return days.join(sums, ["module", "day"], "left").select("position", "module", "day", F.coalesce("v", F.lit(0.0)).alias("value"))


def delta_label(percent: Column) -> Column:
    """The change as text with one decimal; none has its own."""
    sign = F.when(percent > 0, "+").otherwise("")
    return F.when(percent.isNull(), "No previous data").otherwise(F.concat(sign, F.format_string("%.1f", percent), F.lit("% vs previous period")))


#: The website's insights as (label, column, what stands for no value).
TOPS = [("Top page", "path", "/"), ("Top referrer", "referrer", "direct"), ("Top country", "country", "Unknown"), ("Top device", "device_type", "Unknown")]


def website_tops(events: DataFrame, sources: DataFrame, start: date, end: date, sample: int = 2000) -> DataFrame:
    """label, value, n: top page, referrer, country and device of the primary web source's newest `sample` events of the range."""
    primary = web_sources(sources).where("is_primary").select(F.col("id").alias("source_id"))
    rows = events.where(F.col("day").between(F.lit(start), F.lit(end))).join(F.broadcast(primary), "source_id", "left_semi")
    newest = reads.newest(rows, sample)
    each = F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(none)).alias("value")) for label, c, none in TOPS]))
    counts = newest.select("occurred_at", "event_id", each.alias("e")).groupBy("e.label", "e.value").agg(F.count("*").alias("n"), F.max(F.struct("occurred_at", "event_id")).alias("last"))
    return counts.groupBy("label").agg(F.max_by("value", F.struct("n", "last")).alias("value"), F.max("n").alias("n"))


def website_insights(events: DataFrame, sources: DataFrame, start: date, end: date, sample: int = 2000) -> DataFrame:
    """label, value of website_tops."""
    return website_tops(events, sources, start, end, sample).drop("n")


def provider_mix(metrics: DataFrame, start: date, end: date) -> DataFrame:
    """The sign-up provider that leads in the range, with its sign-ups."""
    rows = reads.list_metrics(metrics, ["signups_by_provider"], None, start, end)
    provider = F.coalesce(F.get_json_object("dimensions", "$.provider"), F.lit("unknown"))
    return rows.groupBy(provider.alias("provider")).agg(F.sum("metric_value").alias("signups")).orderBy(F.desc("signups"), "provider").limit(1)


def mark_suppressed(events: DataFrame, sources: DataFrame) -> DataFrame:
    """events (source_id, event_name, ...) with suppressed by rule: a tracker's page view counts nowhere when another source, a drain, is the primary one."""
    kinds = sources.select(F.col("id").alias("s_id"), F.col("type_key").alias("s_type"))
    primary = web_sources(sources).where("is_primary").select(F.col("id").alias("p_id"), F.col("type_key").alias("p_type"))
    rows = events.drop("suppressed").join(F.broadcast(kinds), F.col("source_id") == F.col("s_id"), "left").join(F.broadcast(primary), F.lit(True), "left")  # one row at most
    hit = (F.col("s_type") == "website") & (F.col("event_name") == "page_view") & (F.col("p_id") != F.col("s_id")) & (F.col("p_type") == WEB_KINDS[0])
    return rows.withColumn("suppressed", F.coalesce(hit, F.lit(False))).drop("s_id", "s_type", "p_id", "p_type")


def suppress(events: DataFrame, sources: DataFrame) -> DataFrame:
    """events (source_id, event_name, properties) with suppressed, and the marker in the properties of those."""
    mark = F.lit('"ingestion":{"suppressed_rollup":true,"reason":"drain_primary"}}')
    body = F.expr("left(properties, length(properties) - 1)")
    marked = F.concat(body, F.when(F.col("properties") == "{}", "").otherwise(","), mark)
    return mark_suppressed(events, sources).withColumn("properties", F.when(F.col("suppressed"), marked).otherwise(F.col("properties")))
