"""Sync runs from request to release, sources' rows, credentials, the catalogue, and the seed workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sync import LEASE_MINUTES

STAMP = "yyyy-MM-dd'T'HH:mm:ss"


def life_cycle(requests: DataFrame, sources: DataFrame, locks: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """requests (run_id, seq, source_id, trigger), results (run_id, ok, error, duration_ms, fetched, raw_inserted, own_inserted, updated, upserted) -> the runs.

    A source that is not there is an error, one that is held (a lock that has not expired, or
    an earlier request of this batch) is skipped; others run, and give their counters or error.
    """
    known = sources.select(F.col("id").alias("s_id"), F.col("type_key").alias("source_type_key"))
    held = locks.where(F.col("expires_at") > now).select(F.col("source_id").alias("l_id")).distinct()
    rows = requests.join(F.broadcast(known), F.col("source_id") == F.col("s_id"), "left").join(F.broadcast(held), F.col("source_id") == F.col("l_id"), "left")
    first = F.col("seq") == F.min("seq").over(W.partitionBy("source_id"))
    rows = rows.withColumn("goes", F.col("s_id").isNotNull() & F.col("l_id").isNull() & first).join(results, "run_id", "left")
    done = F.col("goes") & F.coalesce("ok", F.lit(False))
    status = F.when(F.col("s_id").isNull(), "error").when(~F.col("goes"), "skipped").when(done, "success").otherwise("error")
    message = F.when(F.col("s_id").isNull(), "Source not found.").when(~F.col("goes"), "Source is already locked by another sync run.").when(~done, F.coalesce("error", F.lit("Unknown sync failure.")))
    count = lambda c: F.when(done, F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    return rows.select(
        "run_id", "source_id", "source_type_key", "trigger", status.alias("status"), message.alias("error_message"), F.when(F.col("goes"), F.col("duration_ms")).alias("duration_ms"),
        count(F.col("fetched")).alias("records_fetched"), (count(F.col("raw_inserted")) + count(F.col("own_inserted"))).alias("records_inserted"), count(F.col("updated")).alias("records_updated"), count(F.col("upserted")).alias("metrics_upserted"),
        F.when(F.col("goes"), F.date_format(F.to_timestamp(F.lit(now)) + F.expr(f"INTERVAL {LEASE_MINUTES} MINUTES"), STAMP)).alias("lease_until"),
    )


def release(locks: DataFrame, releases: DataFrame) -> DataFrame:
    """locks (source_id, owner, expires_at) without those that their own owner releases (source_id, owner)."""
    return locks.join(releases.select("source_id", "owner"), ["source_id", "owner"], "left_anti")


def run_events(runs: DataFrame) -> DataFrame:
    """The operations log of runs that ran: one event each."""
    ok = F.col("status") == "success"
    event = F.when(ok, "sync_success").otherwise("sync_error")
    return runs.where(F.col("lease_until").isNotNull()).select("run_id", "source_id", event.alias("event_type"), F.when(ok, "info").otherwise("error").alias("severity"), F.when(ok, F.concat_ws(" ", F.col("records_fetched"), F.lit("records fetched."))).otherwise(F.col("error_message")).alias("message"))


def stamps(sources: DataFrame, runs: DataFrame, now: str) -> DataFrame:
    """Each source's stamps after its runs: one for the run's trigger, and for success or error."""
    ran = runs.where(F.col("lease_until").isNotNull()).select(F.col("source_id").alias("id"), "trigger", F.col("status").alias("run_status"))
    at = lambda cond, old: F.when(cond, now).otherwise(F.col(old) if old else F.lit(None).cast("string"))
    return sources.join(F.broadcast(ran), "id").select(
        "id", at(F.col("trigger") == "manual", None).alias("last_manual_at"), at(F.col("trigger") == "cron", None).alias("last_cron_at"), at(F.col("trigger") == "webhook", "last_webhook_at").alias("last_webhook_at"),
        at(F.col("run_status") == "success", "last_success_at").alias("last_success_at"), at(F.col("run_status") == "error", None).alias("last_error_at"),
    )


def created_sources(inputs: DataFrame, now: str) -> DataFrame:
    """inputs (id, type_key, display_name, status, sync_mode, frequency_minutes, supports_webhook, tracking_key) with what a new source gets where it has none."""
    minutes = F.coalesce("frequency_minutes", F.lit(60))
    path = F.when(F.col("type_key") == "vercel_web_analytics_drain", "vercel/analytics-drain").otherwise(F.col("type_key"))
    key = F.concat(F.lit("mq_"), F.left(F.sha2(F.concat_ws(":", "id", F.lit("tracking")), 256), F.lit(20)))
    return inputs.select(
        "id", "type_key", "display_name", F.coalesce("status", F.lit("needs_credentials")).alias("status"), F.coalesce("sync_mode", F.lit("hybrid")).alias("sync_mode"), minutes.alias("frequency_minutes"),
        F.when(F.col("supports_webhook"), F.concat(F.lit("/api/webhooks/"), path, F.lit("/"), F.col("id"))).alias("webhook_path"), F.when(F.col("type_key") == "website", F.coalesce("tracking_key", key)).otherwise(F.col("tracking_key")).alias("tracking_key"),
        F.date_format(F.to_timestamp(F.lit(now)) + F.make_interval(mins=minutes), STAMP).alias("next_sync_at"), F.lit(now).alias("created_at"),
    )


#: Fields of a source kind's credentials: key and whether it is required.
FIELDS = {"supabase": [("project_url", True), ("service_role_key", True), ("profiles_table", False)], "shopify": [("shop_domain", True), ("access_token", True)], "website": []}


def credential_check(bodies: DataFrame, sources: DataFrame) -> DataFrame:
    """bodies (source_id, body: JSON) -> source_id, saved, unknown, missing, status.

    Only entries that are text count, under credentials or at the top. An unknown key saves
    nothing; blank values are not saved; the first save moves needs_credentials to warning.
    """
    spark = bodies.sparkSession
    fields = spark.createDataFrame([(k, [f for f, _ in v], [f for f, r in v if r]) for k, v in FIELDS.items()], "type_key string, fields array<string>, required array<string>")
    text = F.coalesce(F.get_json_object("body", "$.credentials"), F.col("body"))
    entries = F.map_filter(F.coalesce(F.from_json(text, "map<string,variant>"), F.expr("map()").cast("map<string,variant>")), lambda k, v: F.schema_of_variant(v) == "STRING")
    values = F.transform_values(entries, lambda k, v: F.trim(v.cast("string")))
    rows = bodies.join(F.broadcast(sources.select(F.col("id").alias("source_id"), "type_key", "status")), "source_id").join(F.broadcast(fields), "type_key", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"values": values, "fields": F.coalesce("fields", none), "required": F.coalesce("required", none)})
    unknown = F.array_except(F.map_keys("values"), "fields")
    saved = F.when(F.size(unknown) > 0, none).otherwise(F.map_keys(F.map_filter("values", lambda k, v: v != "")))
    rows = rows.withColumns({"unknown": unknown, "saved": saved})
    missing = F.when(F.size("unknown") > 0, none).otherwise(F.array_except("required", "saved"))
    rows = rows.withColumn("missing", missing)
    fine = (F.col("status") == "needs_credentials") & (F.size("saved") > 0) & (F.size("missing") == 0) & (F.size("unknown") == 0)
    joined = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return rows.select("source_id", joined("saved"), joined("unknown"), joined("missing"), F.when(fine, "warning").otherwise(F.col("status")).alias("status"))


def catalogue_upsert(existing: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Definitions (key, title, created_at, updated_at) with new ones (key, title): replaced by key, created_at kept."""
    rows = existing.join(new.select(F.col("key").alias("n_key"), F.col("title").alias("n_title")), F.col("key") == F.col("n_key"), "full")
    is_new = F.col("n_key").isNotNull()
    return rows.select(F.coalesce("key", "n_key").alias("key"), F.when(is_new, F.col("n_title")).otherwise(F.col("title")).alias("title"), F.coalesce("created_at", F.lit(now)).alias("created_at"), F.when(is_new, now).otherwise(F.col("updated_at")).alias("updated_at"))


def seed_metrics(spark: SparkSession, as_of: str, days: int = 60) -> DataFrame:
    """day, metric_key, metric_value: waves and trends of a demo workspace, the last day being as_of."""
    age, back = F.col("id"), F.lit(days - 1) - F.col("id")
    half_up = lambda x: F.floor(x + 0.5).cast("double")
    rows = spark.range(days).withColumn("views", half_up(780 + age * 18 + F.sin(age / 4) * 90)).withColumn("visitors", half_up(F.col("views") * 0.42 + (back % 4) * 12))
    values = {
        "page_views": F.col("views"), "unique_visitors": F.col("visitors"), "sessions": half_up(F.col("visitors") * 1.28), "custom_events": half_up(F.col("views") * 0.12 + (back % 5) * 8),
        "signups": F.greatest(F.lit(3.0), half_up(12 + age * 0.55 + F.cos(age / 3) * 4)), "users_total": (500 + age * 13).cast("double"), "confirmed_users": half_up((500 + age * 13) * 0.78),
        "video_views": (1200 + age * 33).cast("double"), "reach": (900 + age * 21).cast("double"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric_key"), v.alias("metric_value")) for k, v in values.items()]))
    return rows.select(F.date_sub(F.lit(as_of).cast("date"), back.cast("int")).alias("day"), each.alias("m")).select("day", "m.*")


def seed_users(spark: SparkSession, as_of: str, n: int = 8) -> DataFrame:
    """user_id, day, provider of n demo users, one for each day back; every third came by google."""
    k = F.col("id")
    return spark.range(n).select(F.concat(F.lit("demo_user_"), k + 1).alias("user_id"), F.date_sub(F.lit(as_of).cast("date"), k.cast("int")).alias("day"), F.when(k % 3 == 0, "google").otherwise("email").alias("provider"))


def heartbeats(sources: DataFrame, trigger: str) -> DataFrame:
    """source_id, payload, payload_hash: one payload of each web source, without a time in it, so that repeats land once."""
    payload = F.to_json(F.struct(F.lit("heartbeat").alias("kind"), F.col("id").alias("source_id"), F.lit(trigger).alias("trigger")))
    rows = sources.where(F.col("type_key").isin("website", "vercel_web_analytics_drain")).select(F.col("id").alias("source_id"), payload.alias("payload"))
    return rows.withColumn("payload_hash", F.sha2("payload", 256))


def scaffold_payloads(sources: DataFrame) -> DataFrame:
    """source_id, payload of the sources that are scaffolds: what a connector that fetches nothing yet lands."""
    return sources.where("scaffold").select(F.col("id").alias("source_id"), F.to_json(F.struct(F.lit(True).alias("scaffold"), F.col("type_key").alias("source_type"))).alias("payload"))

