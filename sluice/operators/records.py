"""Module records: all that the dashboard shows of a module, one nested row each.

The metrics are scanned once, for both periods, and joined to the modules' configuration before
they are grouped: after the first shuffle there is at most a row for each module, metric, day and
sign-up provider. Series, totals, newest values and the leading provider all come from these rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import modules, reads
from .sync import WEB_KINDS, placeholder_status, setup_state, web_sources

#: Names of modules and metrics, texts of a module's setup state.
MODULE_LABELS = {"website": "Website", "supabase": "Users", "tiktok": "TikTok", "instagram": "Instagram", "shopify": "Commerce", "custom_api": "Custom API", "custom_csv": "Custom CSV"}
METRIC_LABELS = {
    "unique_visitors": "Unique visitors", "page_views": "Page views", "sessions": "Sessions", "custom_events": "Custom events", "signups": "New signups", "users_total": "Users total", "confirmed_users": "Confirmed users",
    "signups_by_provider": "Provider signups", "video_views": "Video views", "likes": "Likes", "comments": "Comments", "shares": "Shares", "engagement_rate": "Engagement", "reach": "Reach", "impressions": "Impressions",
    "followers": "Followers", "profile_views": "Profile views", "orders": "Orders", "net_payment": "Net payment", "gross_sales": "Gross sales", "refunds": "Refunds", "records_fetched": "Records", "records_inserted": "Inserted",
    "records_updated": "Updated", "rows_imported": "Rows imported", "files_processed": "Files", "rows_rejected": "Rejected",
}
NO_TRAFFIC = "Waiting for live traffic"
NO_PROVIDERS = "Provider breakdown arrives after the first sync."
MESSAGES = {
    ("Needs setup", "website"): "Add a website source and choose one primary way of ingestion.",
    ("Needs setup", "supabase"): "Add the user project and save its service role key on the server.",
    ("Connected", None): "This source is live and syncs through the shared engine.",
    ("Needs credentials", "supabase"): "Save the service role key on the server, or finish the webhook setup.",
    ("Needs credentials", "website"): "Choose drain or tracker and finish its setup.",
    ("Needs credentials", None): "Finish the connector setup before expecting private metrics.",
    ("Disabled", None): "This module is parked until its source is ready.",
    ("Scaffold demo", None): "The connector is ready; collection can be added later.",
    ("Demo mode", None): "Showing demo data until the real source is connected.",
}
SYNC_ERROR = "The last sync failed. Review the source and its events."
#: A source's stamps, the first that is set being its last sync.
STAMPS = ["last_success_at", "last_webhook_at", "last_manual_at", "last_cron_at"]


def latest_sync(sources: DataFrame) -> Column:
    return F.coalesce(*[F.col(c) if c in sources.columns else F.lit(None).cast("string") for c in STAMPS])


def website_mode(kind: Column, status: Column) -> Column:
    return F.when(kind.isNull(), "Demo").when(kind == WEB_KINDS[0], "Vercel Drain").when(status == "demo", "Demo").otherwise("Website Tracker")


def mode_label(module: Column, kind: Column, status: Column, scaffold: Column) -> Column:
    other = F.when(kind.isNull(), "Future").when(scaffold, "Scaffold").otherwise("Monitored Source")
    return F.when(module == "website", website_mode(kind, status)).when(module == "supabase", F.when(kind.isNull(), "Needs setup").otherwise("Supabase Source")).otherwise(other)


def setup_message(module: Column, label: Column, mode: Column, last_error: Column) -> Column:
    """What is to be done about a module's setup state; of two texts for a state the module's own wins."""
    out = F.when(label == "Sync error", F.coalesce(last_error, F.lit(SYNC_ERROR))).when(label == "Future", F.concat(_named(module, MODULE_LABELS), F.lit(" is prepared for a future source.")))
    out = out.when(label == "Primary mode active", F.concat(mode, F.lit(" is the active way of ingestion. Keep the secondary source idle to avoid double counting.")))
    for (state, of), text in sorted(MESSAGES.items(), key=lambda x: x[0][1] is None):
        out = out.when((label == state) & (F.lit(True) if of is None else module == of), text)
    return out


def _named(key: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[key], key)


def _number(value: Column) -> Column:
    whole = value == F.floor(value)
    return F.when(whole, F.format_string("%d", value.cast("long"))).otherwise(value.cast("string"))


def _values(metrics: DataFrame, config: DataFrame, start: date, end: date) -> DataFrame:
    """module, metrics (slot, value, previous), series (day, value), provider (signups, provider) of the modules with any rows."""
    before = reads.previous_range(start, end)
    rows = reads.list_metrics(metrics, sorted(modules.UNITS), None, before[0], end).withColumnRenamed("metric_key", "key")
    own = F.col("own_id").isNull() | (F.col("own_id") == F.col("source_id"))
    found = rows.join(F.broadcast(config), (F.col("key") == F.col("metric_key")) & (F.col("source_type_key") == F.col("kind")) & own)
    provider = F.when(F.col("key") == "signups_by_provider", F.coalesce(F.get_json_object("dimensions", "$.provider"), F.lit("unknown")))
    newest = F.max(F.struct("day", F.coalesce("source_id", F.lit("")).alias("s"), "dimensions", "metric_value")).alias("newest")
    by_day = found.groupBy("module", "slot", "mode", provider.alias("provider"), "day").agg(F.sum("metric_value").alias("v"), newest)
    now = F.col("day") >= F.lit(start)
    point = F.when(now & (F.col("slot") == 0), F.struct("day", F.col("v").alias("value")))
    by_provider = by_day.groupBy("module", "slot", "mode", "provider").agg(
        F.sum(F.when(now, F.col("v"))).alias("v"), F.sum(F.when(~now, F.col("v"))).alias("p"), F.max(F.when(now, F.col("newest"))).alias("newest"), F.collect_list(point).alias("series")
    )
    value = F.when(F.col("mode") == "latest", F.max("newest")["metric_value"]).otherwise(F.sum("v"))
    leads = F.min(F.when(F.col("provider").isNotNull() & F.col("v").isNotNull(), F.struct((-F.col("v")).alias("less"), "provider")))
    by_slot = by_provider.groupBy("module", "slot", "mode").agg(value.alias("value"), F.sum("p").alias("previous"), F.flatten(F.collect_list("series")).alias("series"), leads.alias("leads"))
    return by_slot.groupBy("module").agg(F.collect_list(F.struct("slot", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("previous", F.lit(0.0)).alias("previous"))).alias("found"), F.flatten(F.collect_list("series")).alias("series"), F.min("leads").alias("leads"))


def _traffic(events: DataFrame, sources: DataFrame, start: date, end: date) -> DataFrame:
    """One row: the website's insights, as `entry (n)`, with a text of its own for each that has no events."""
    tops = modules.website_tops(events, sources, start, end)
    labels = events.sparkSession.createDataFrame(list(enumerate(x[0] for x in modules.TOPS)), "at int, label string")
    text = F.coalesce(F.concat("value", F.lit(" ("), F.col("n").cast("string"), F.lit(")")), F.lit(NO_TRAFFIC))
    rows = labels.join(tops, "label", "left").select(F.struct("at", "label", text.alias("value")).alias("x"))
    return rows.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value"))).alias("traffic"))


def module_records(metrics: DataFrame, events: DataFrame, sources: DataFrame, start: date, end: date) -> DataFrame:
    """A row for each module, in their order, whether or not it has a source, metrics or events.

    metrics: typed. position, module, label, source_id, display_name, status, sync_mode, mode_label, main (key, label,
    unit, value, previous, delta_percent, delta_label), secondary (array of key, label, unit, value), sparkline
    (array of day, value: every day of the range), insights (array of label, value), last_sync_at, next_sync_at,
    last_error, setup (label, severity, message), actions (can_run, can_configure).
    """
    spark = metrics.sparkSession
    chosen = modules.chosen_sources(sources.withColumn("synced", latest_sync(sources)))
    chosen = chosen.select("module", F.col("id").alias("own_id"), F.col("type_key").alias("own_kind"), "display_name", F.col("status").alias("own_status"), "sync_mode", "next_sync_at", "synced", "last_success_at", "last_error", F.coalesce("scaffold", F.lit(False)).alias("scaffold"))
    config = spark.createDataFrame(modules.CONFIG, modules.CONFIG_SCHEMA).join(F.broadcast(chosen.select("module", "own_id", F.col("own_kind").alias("kind"))), "module", "left").withColumn("kind", F.coalesce("kind", "module"))
    values = _values(metrics, config, start, end)

    shape = "array<struct<key:string,label:string,unit:string>>"
    each = [(p, m, MODULE_LABELS[m], [(k, METRIC_LABELS[k], u) for k, u, _ in found[: modules.SECONDARY + 1]]) for p, (m, found) in enumerate(modules.METRICS.items())]
    base = spark.createDataFrame(each, f"position int, module string, label string, shown {shape}")
    secondary = web_sources(sources).where(~F.col("is_primary")).agg((F.count("*") > 0).alias("has_secondary"))  # one row
    rows = base.join(F.broadcast(chosen), "module", "left").join(F.broadcast(secondary), F.lit(True), "left").join(values, "module", "left").join(F.broadcast(_traffic(events, sources, start, end)), F.lit(True), "left")

    at = lambda slot: F.get(F.filter("found", lambda x: x["slot"] == slot), F.lit(0))
    shown = F.transform("shown", lambda s, i: F.struct(s["key"].alias("key"), s["label"].alias("label"), s["unit"].alias("unit"), F.coalesce(at(i)["value"], F.lit(0.0)).alias("value"), F.coalesce(at(i)["previous"], F.lit(0.0)).alias("previous")))
    rows = rows.withColumn("shown", shown)
    first = F.element_at("shown", 1)
    percent = reads.delta(first["value"], first["previous"])
    main = F.struct(first["key"].alias("key"), first["label"].alias("label"), first["unit"].alias("unit"), first["value"].alias("value"), first["previous"].alias("previous"), percent.alias("delta_percent"), modules.delta_label(percent).alias("delta_label"))
    rest = F.transform(F.slice("shown", 2, modules.SECONDARY), lambda s: F.struct(*[s[c].alias(c) for c in ("key", "label", "unit", "value")]))
    points = F.map_from_entries(F.coalesce("series", F.array().cast("array<struct<day:date,value:double>>")))
    line = F.transform(F.sequence(F.lit(start), F.lit(end)), lambda d: F.struct(d.alias("day"), F.coalesce(points[d], F.lit(0.0)).alias("value")))
    entry = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    leader = F.coalesce(F.concat(F.col("leads.provider"), F.lit(" leads with "), _number(-F.col("leads.less")), F.lit(" signups in this range.")), F.lit(NO_PROVIDERS))
    fresh = F.coalesce(F.concat(F.lit("Last successful sync "), F.col("last_success_at")), F.lit("Waiting for first sync"))
    insights = F.when(F.col("module") == "website", F.col("traffic")).when(F.col("module") == "supabase", F.array(entry("Provider mix", leader), entry("Freshness", fresh))).otherwise(F.array().cast("array<struct<label:string,value:string>>"))
    mode = mode_label(F.col("module"), F.col("own_kind"), F.col("own_status"), F.coalesce("scaffold", F.lit(False)))
    state = setup_state(F.col("module"), F.col("own_status"), F.col("has_secondary"), F.coalesce("scaffold", F.lit(False)))
    message = setup_message(F.col("module"), state["label"], website_mode(F.col("own_kind"), F.col("own_status")), F.col("last_error"))
    status = F.coalesce("own_status", placeholder_status(F.col("module")))
    has = F.col("own_id").isNotNull()
    return rows.select(
        "position", "module", "label", F.col("own_id").alias("source_id"), F.coalesce("display_name", "label").alias("display_name"), status.alias("status"), F.coalesce("sync_mode", F.lit("manual")).alias("sync_mode"), mode.alias("mode_label"),
        main.alias("main"), rest.alias("secondary"), line.alias("sparkline"), insights.alias("insights"), F.col("synced").alias("last_sync_at"), "next_sync_at", "last_error",
        F.struct(state["label"].alias("label"), state["severity"].alias("severity"), message.alias("message")).alias("setup"), F.struct((has & (status != "disabled")).alias("can_run"), has.alias("can_configure")).alias("actions"),
    )
