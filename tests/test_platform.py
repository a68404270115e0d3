"""The typed table, module records, strict deliveries and sync runs beyond their queries."""

import json

from pyspark.sql import functions as F

from sluice.operators import modules, reads, rollup, runs, store, validate
from sluice.plans import platform
from sluice.sources import deliveries, tables


def plan_of(frame):
    frame.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "3000")
    return frame._jdf.queryExecution().executedPlan().toString()


def test_stored_metrics_are_read_by_day_and_metric(spark, small, tmp_path):
    path = f"{tmp_path}/metrics"
    store.overwrite_days(modules.typed(rollup.daily_rollup(tables.web_events(spark, small)), tables.sources(spark)), path)
    before = spark.read.parquet(path).count()
    rows = reads.list_metrics(spark.read.parquet(path), ["page_views"], "src_drain", *reads.date_range("7d", tables.AS_OF))
    plan = plan_of(rows)
    assert "PartitionFilters: [isnotnull(day" in plan and "EqualTo(metric_key,page_views)" in plan and "EqualTo(source_id,src_drain)" in plan
    # Only the days of the delta are written anew.
    day = spark.read.parquet(path).where("day = '2024-01-05'").withColumn("metric_value", F.col("metric_value") + 1).persist()
    old = day.agg({"metric_value": "sum"}).first()[0]
    n = day.count()
    store.overwrite_days(day, path)
    again = spark.read.parquet(path)
    assert again.count() == before and again.where("day = '2024-01-05'").agg({"metric_value": "sum"}).first()[0] == old and n > 0


def test_counters_spread_counts_not_events(spark, small):
    plan = plan_of(rollup.counters(tables.web_events(spark, small)))
    assert plan.index("Generate") < plan.rindex("HashAggregate")  # printed from the top: counted below, spread above


def test_a_module_without_source_sums_all_rows_of_its_kind(spark):
    rows = [("2024-01-30", f"s{k}", "tiktok", "video_views", "{}", 5.0) for k in range(3)] + [("2024-01-29", "s0", "tiktok", "engagement_rate", "{}", 1.0), ("2024-01-30", "s1", "tiktok", "engagement_rate", "{}", 2.0), ("2024-01-30", "s9", "instagram", "video_views", "{}", 100.0)]
    typed = spark.createDataFrame(rows, "day string, source_id string, source_type_key string, metric_key string, dimensions string, metric_value double").withColumn("day", F.to_date("day"))
    got = {(r["module"], r["metric_key"]): r["value"] for r in modules.module_values(typed, tables.sources(spark).where("false"), *reads.date_range("7d", "2024-01-30")).collect()}
    assert got["tiktok", "video_views"] == 15.0 and got["tiktok", "engagement_rate"] == 2.0 and got["instagram", "reach"] == 0.0
    one = tables.sources(spark).where("id = 'src_video'").withColumn("id", F.lit("s2"))
    got = {(r["module"], r["metric_key"]): r["value"] for r in modules.module_values(typed, one, *reads.date_range("7d", "2024-01-30")).collect()}
    assert got["tiktok", "video_views"] == 5.0 and got["tiktok", "engagement_rate"] == 0.0


def test_strict_deliveries(spark):
    bodies = [(1, None), (2, ""), (3, " \n "), (4, "[]"), (5, '[{"path":"/x"},{"path":"/y"}]'), (6, '{"a":1} trailing'), (7, '"text"'), (8, '{"eventData":"{\\"vercel\\":1}"}'), (9, '{"eventData":"say \\"hi\\" \\\\ é"}'), (10, '{"eventData":"null"}'), (11, "null")]
    events, rejects = deliveries.parse(spark.createDataFrame(bodies, "delivery_id long, body string"))
    got = {(r["delivery_id"], r["position"]): json.loads(r["properties"]) for r in deliveries.to_log(events, F.lit("https://s.example")).collect()}
    assert sorted(got) == [(5, 0), (5, 1), (8, 0), (9, 0), (10, 0)]
    assert got[8, 0] == {"vercel": 1} and got[9, 0]["raw"] == 'say "hi" \\ é' and list(got[10, 0]) == ["vercel"]
    assert sorted(r["delivery_id"] for r in rejects.collect()) == [6, 7, 11]


def test_suppression_needs_a_drain_as_primary(spark):
    events = spark.createDataFrame([("src_tracker", "page_view", "{}"), ("src_tracker", "click", "{}"), ("src_drain", "page_view", "{}"), (None, "page_view", None)], "source_id string, event_name string, properties string")
    count = lambda sources: modules.suppress(events, sources).where("suppressed").count()
    sources = tables.sources(spark)
    assert count(sources) == 1 and count(sources.where("id <> 'src_drain'")) == 0 and count(sources.where("false")) == 0
    assert modules.suppress(events, sources.where("false")).count() == 4


def test_runs_without_sources_and_identities_without_ids(spark):
    ask = spark.createDataFrame([("a", 1, None, "cron"), ("b", 2, "src_users", "cron")], platform.REQUESTS_SCHEMA)
    none = lambda schema: spark.createDataFrame([], schema)
    got = {r["run_id"]: (r["status"], r["error_message"]) for r in runs.life_cycle(ask, tables.sources(spark), none(tables.LOCKS_SCHEMA), none(platform.RESULTS_SCHEMA), tables.NOW).collect()}
    assert got == {"a": ("error", "Source not found."), "b": ("error", "Unknown sync failure.")}
    schema = "probe_id long, source_id string, day string, anonymous_id string, session_id string"
    log = spark.createDataFrame([(0, "s", "d", "v", None), (0, "s", "d", "v", None)], schema)
    probes = spark.createDataFrame([(None, "s", "d", "v", "x"), (1, "s", "d", "w", None), (1, "s", "d", "v", None), (2, None, "d", "v", "x")], schema)
    assert sorted(r["seen"] for r in validate.identity_seen(probes, log).collect()) == [False, False, True, True]
