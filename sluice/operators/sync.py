"""Sources' state: what is due, what a run changes, who holds a lease, which source leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Web sources and their order of preference.
WEB_KINDS = ["vercel_web_analytics_drain", "website"]
LEASE_MINUTES = 5
#: The dashboard's modules: key, main metric, and source kind.
MODULES = [("website", "unique_visitors"), ("supabase", "signups"), ("tiktok", "video_views"), ("instagram", "reach"), ("shopify", "orders"), ("custom_api", "records_fetched"), ("custom_csv", "rows_imported")]


def due(sources: DataFrame, now: str) -> DataFrame:
    """Sources to run now, longest due first."""
    waiting = F.col("next_sync_at").isNull() | (F.col("next_sync_at") <= now)
    rows = sources.where((F.col("status") != "disabled") & ~F.col("sync_mode").isin("manual", "webhook") & waiting)
    return rows.orderBy(F.coalesce("next_sync_at", "created_at"), "id")


def after_run(sources: DataFrame, runs: DataFrame, now: str) -> DataFrame:
    """Sources after runs (source_id, trigger, ok, error): next time, status and stamps."""
    r = runs.select(F.col("source_id").alias("r_id"), "trigger", "ok", "error")
    rows = sources.join(F.broadcast(r), F.col("id") == F.col("r_id"))
    at = F.date_format(F.to_timestamp(F.lit(now)) + F.make_interval(mins="frequency_minutes"), "yyyy-MM-dd'T'HH:mm:ss")
    status = F.when(~F.col("ok"), "error").when(F.col("status") == "demo", "demo").otherwise("healthy")
    return rows.select(
        "id", status.alias("status"), at.alias("next_sync_at"), F.when(F.col("ok"), now).otherwise(F.col("last_success_at")).alias("last_success_at"),
        F.when(F.col("trigger") == "webhook", now).otherwise(F.col("last_webhook_at")).alias("last_webhook_at"), F.when(~F.col("ok"), F.coalesce("error", F.lit("Sync failed."))).alias("last_error"),
    )


def acquire(locks: DataFrame, requests: DataFrame, now: str) -> DataFrame:
    """requests (seq, source_id, owner) with whether each gets the lease: only the first, and only on none or an expired one."""
    held = locks.where(F.col("expires_at") > now).select(F.col("source_id").alias("l_id"))
    rows = requests.withColumn("first", F.min("seq").over(W.partitionBy("source_id"))).join(F.broadcast(held), F.col("source_id") == F.col("l_id"), "left")
    won = (F.col("seq") == F.col("first")) & F.col("l_id").isNull()
    until = F.date_format(F.to_timestamp(F.lit(now)) + F.expr(f"INTERVAL {LEASE_MINUTES} MINUTES"), "yyyy-MM-dd'T'HH:mm:ss")
    return rows.select("seq", "source_id", "owner", won.alias("acquired"), F.when(won, until).alias("expires_at"))


def preference() -> Column:
    return F.array_position(F.array(*map(F.lit, WEB_KINDS)), F.col("type_key"))


def web_sources(sources: DataFrame) -> DataFrame:
    """Web sources with is_primary: the preferred one that is not disabled."""
    rows = sources.where(F.col("type_key").isin(WEB_KINDS))
    rank = F.row_number().over(W.orderBy((F.col("status") == "disabled").cast("int"), preference(), "display_name"))
    return rows.withColumn("is_primary", (rank == 1) & (F.col("status") != "disabled"))


def mode_label(kind: Column, status: Column) -> Column:
    return F.when(kind.isNull(), "Demo").when(kind == WEB_KINDS[0], "Drain").when(status == "demo", "Demo").otherwise("Tracker")


def setup_state(module: Column, status: Column, has_secondary: Column, scaffold: Column) -> Column:
    """(label, severity) of a module's setup; a null status means that it has no source."""
    state = lambda label, severity: F.struct(F.lit(label).alias("label"), F.lit(severity).alias("severity"))
    return (
        F.when(status.isNull() & module.isin("website", "supabase"), state("Needs setup", "warning")).when(status.isNull(), state("Future", "demo"))
        .when((status == "healthy") & (module == "website") & has_secondary, state("Primary mode active", "ok")).when(status == "healthy", state("Connected", "ok"))
        .when(status == "needs_credentials", state("Needs credentials", "warning")).when(status == "error", state("Sync error", "error"))
        .when(status == "disabled", state("Disabled", "error")).when(scaffold, state("Scaffold demo", "demo")).otherwise(state("Demo mode", "demo"))
    )


def placeholder_status(module: Column) -> Column:
    return F.when(module.isin("shopify", "custom_api", "custom_csv"), "disabled").otherwise("demo")


def modules(sources: DataFrame, deltas: DataFrame) -> DataFrame:
    """The modules in their order with source, main metric and setup state.

    deltas: source_id, metric_key, current_value, previous_value.
    """
    from .reads import delta

    spark = sources.sparkSession
    config = spark.createDataFrame([(k, *m) for k, m in enumerate(MODULES)], "position int, module string, metric_key string")
    web = web_sources(sources)
    first = W.partitionBy("type_key").orderBy("display_name")
    others = sources.where(~F.col("type_key").isin(WEB_KINDS)).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    chosen = web.where("is_primary").drop("is_primary").withColumn("module", F.lit("website")).unionByName(others.withColumn("module", F.col("type_key")))
    chosen = chosen.select("module", F.col("id").alias("source_id"), "status", "scaffold", F.coalesce("last_success_at", "last_webhook_at").alias("last_sync_at"), "last_error")
    secondary = web.where(~F.col("is_primary")).agg((F.count("*") > 0).alias("has_secondary"))
    rows = config.join(F.broadcast(chosen), "module", "left").crossJoin(F.broadcast(secondary)).join(deltas, ["source_id", "metric_key"], "left")
    state = setup_state(F.col("module"), F.col("status"), F.col("has_secondary"), F.coalesce("scaffold", F.lit(False)))
    now, before = (F.coalesce(c, F.lit(0.0)) for c in ("current_value", "previous_value"))
    return rows.select(
        "position", "module", "source_id", F.coalesce("status", placeholder_status(F.col("module"))).alias("status"), "metric_key", now.alias("current_value"), before.alias("previous_value"),
        F.round(delta(now, before), 6).alias("delta_percent"), state["label"].alias("setup_label"), state["severity"].alias("setup_severity"), "last_sync_at", "last_error",
    )
