"""Roll-ups: events and users to rows of the daily metrics table.

A metric row is (day, source_id, metric_key, dimensions, dimensions_hash, metric_value);
dimensions is canonical JSON (sorted keys), so its hash does not depend on key order.
Aggregations combine before the shuffle; a hot source or day costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["day", "source_id", "metric_key", "dimensions_hash"]


def canonical(dimensions: Column) -> Column:
    """A map of strings as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(dimensions))))


def dims(**kv: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(kv.items())]))


def _metric(key: Column | str, dimensions: Column) -> Column:
    return F.struct((F.lit(key) if isinstance(key, str) else key).alias("metric_key"), dimensions.alias("dimensions"))


ROLLUP = '{"rollup":"daily"}'


def counters(events: DataFrame) -> DataFrame:
    """Counts by event kind, path and referrer of the unsuppressed events.

    Events are counted by all three together first, and the counts are spread and summed:
    a row for each combination of a day, not three for each event.
    """
    kind = F.when(F.col("event_name") == "page_view", "page_views").otherwise("custom_events")
    referrer = F.coalesce(F.nullif(F.col("referrer"), F.lit("")), F.lit("direct"))
    found = events.where(~F.col("suppressed")).groupBy("day", "source_id", kind.alias("kind"), "path", referrer.alias("referrer")).agg(F.count("*").alias("n"))
    each = F.array(_metric(F.col("kind"), F.lit(ROLLUP)), _metric("events_by_path", dims(path=F.col("path"))), _metric("events_by_referrer", dims(referrer=F.col("referrer"))))
    rows = found.select("day", "source_id", "n", F.explode(each).alias("m")).select("day", "source_id", "n", "m.*")
    return rows.groupBy("day", "source_id", "metric_key", "dimensions").agg(F.sum("n").cast("double").alias("metric_value"))


def first_seen(events: DataFrame, identity: str) -> DataFrame:
    """(day, source_id, counted, lost): identities whose first event of the day counts, or is suppressed.

    The first event is taken by ingestion order with a combining aggregate, not a window,
    so a visitor with very many events is one row after the map side.
    """
    first = events.groupBy("source_id", "day", identity).agg(F.min_by("suppressed", "event_id").alias("suppressed"))
    return first.groupBy("day", "source_id").agg(F.count_if(~F.col("suppressed")).alias("counted"), F.count_if("suppressed").alias("lost"))


def hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("dimensions_hash", F.sha2("dimensions", 256))


def daily_rollup(events: DataFrame) -> DataFrame:
    """Counters, visitors and sessions from one pass over the events.

    Grouping sets count events by kind, path and referrer and find the first event of each visitor and of
    each session in the same aggregate, which combines before its shuffle. What leaves it is a
    row for each such combination; the second aggregate makes the metrics of these.
    """
    kind = F.when(F.col("event_name") == "page_view", "page_views").otherwise("custom_events")
    referrer = F.coalesce(F.nullif(F.col("referrer"), F.lit("")), F.lit("direct"))
    rows = events.select("day", "source_id", kind.alias("kind"), "path", referrer.alias("referrer"), "anonymous_id", "session_id", "event_id", "suppressed")
    place, counted = ["day", "source_id"], ["kind", "path", "referrer"]
    sets = [[*place, *counted], [*place, "anonymous_id"], [*place, "session_id"]]
    found = rows.groupingSets(sets, *place, *counted, "anonymous_id", "session_id").agg(
        F.grouping("kind").alias("of_identity"), F.grouping("anonymous_id").alias("no_visitor"), F.count_if(~F.col("suppressed")).alias("n"), F.min_by("suppressed", "event_id").alias("lost")
    )
    identity = F.array(_metric(F.when(F.col("no_visitor") == 0, "unique_visitors").otherwise("sessions"), F.lit(ROLLUP)))
    counters_ = F.array(_metric(F.col("kind"), F.lit(ROLLUP)), _metric("events_by_path", dims(path=F.col("path"))), _metric("events_by_referrer", dims(referrer=F.col("referrer"))))
    is_identity = F.col("of_identity") == 1
    value = F.when(is_identity, F.when(~F.col("lost"), 1)).otherwise(F.when(F.col("n") > 0, F.col("n")))
    each = found.withColumn("v", value).where("v IS NOT NULL").select(*place, "v", F.explode(F.when(is_identity, identity).otherwise(counters_)).alias("m")).select(*place, "v", "m.*")
    return hashed(each.groupBy(*place, "metric_key", "dimensions").agg(F.sum("v").cast("double").alias("metric_value")))


def user_metrics(users: DataFrame) -> DataFrame:
    """Signups, running totals of users and confirmed users, and signups by provider.

    The running totals are over one row a day, the only rows that meet in one task.
    """
    by_day = users.groupBy("day").agg(F.count("*").alias("n"), F.count_if("confirmed").alias("c"))
    run = W.orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = by_day.withColumns({"total": F.sum("n").over(run), "sure": F.sum("c").over(run)})
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric_key"), F.col(c).cast("double").alias("metric_value")) for k, c in (("signups", "n"), ("users_total", "total"), ("confirmed_users", "sure"))]))
    rows = totals.select("day", each.alias("m")).select("day", "m.*").withColumn("dimensions", F.lit(ROLLUP))
    split = users.groupBy("day", "provider").count().select("day", F.lit("signups_by_provider").alias("metric_key"), F.col("count").cast("double").alias("metric_value"), dims(provider=F.col("provider")).alias("dimensions"))
    return hashed(rows.unionByName(split).withColumn("source_id", F.lit("src_users")))
