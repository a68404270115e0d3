"""Module records beyond their queries: one scan, defined results for what is missing, texts of every state."""

import pytest
from pyspark.sql import functions as F

from sluice.operators import modules, reads, records, store
from sluice.plans.platform import typed
from sluice.sources import tables

RANGE = reads.date_range("7d", tables.AS_OF)
METRICS = "day date, source_id string, source_type_key string, metric_key string, dimensions string, metric_value double"


@pytest.fixture(scope="module")
def no_events(spark, small):
    return tables.web_events(spark, small).where("false")


def of(rows, module):
    return next(r for r in rows if r["module"] == module)


def test_the_metrics_are_scanned_once_with_days_and_keys_pushed(spark, small, tmp_path):
    path = f"{tmp_path}/metrics"
    store.overwrite_days(typed(spark, small), path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "3000")
    plan = records.module_records(spark.read.parquet(path), tables.web_events(spark, small), tables.sources(spark), *RANGE)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and path in line]
    assert len(scans) == 1 and "day#" in scans[0].split("PartitionFilters")[1] and "In(metric_key" in scans[0].split("PushedFilters")[1]
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_nothing_at_all(spark, no_events):
    rows = records.module_records(spark.createDataFrame([], METRICS), no_events, tables.sources(spark).where("false"), *RANGE).collect()
    assert [r["module"] for r in sorted(rows, key=lambda r: r["position"])] == list(modules.METRICS)
    web = of(rows, "website")
    assert {i["value"] for i in web["insights"]} == {records.NO_TRAFFIC} and web["main"]["delta_label"] == "0.0% vs previous period" and len(web["sparkline"]) == 7
    assert web["setup"]["severity"] == of(rows, "supabase")["setup"]["severity"] == "warning" and of(rows, "custom_api")["setup"]["label"] == "Future"
    assert of(rows, "shopify")["status"] == "disabled" and not web["actions"]["can_run"] and all(r["setup"]["message"] for r in rows)


def test_values_series_and_the_leading_provider(spark, no_events):
    day = lambda d: f"2024-01-{d}"
    rows = [
        (day(30), "src_users", "supabase", "signups", "{}", 3.0), (day(30), "src_users", "supabase", "signups", '{"x":"1"}', 1.0), (day(24), "src_users", "supabase", "signups", "{}", 2.0), (day(23), "src_users", "supabase", "signups", "{}", 4.0), (day(16), "src_users", "supabase", "signups", "{}", 99.0),
        (day(25), "src_users", "supabase", "users_total", "{}", 50.0), (day(29), "src_users", "supabase", "users_total", "{}", 49.0), (day(22), "src_users", "supabase", "users_total", "{}", 70.0), (day(30), "other", "supabase", "signups", "{}", 1000.0),
        (day(30), "src_users", "supabase", "signups_by_provider", '{"provider":"google"}', 2.0), (day(24), "src_users", "supabase", "signups_by_provider", '{"provider":"email"}', 2.0), (day(24), "src_users", "supabase", "signups_by_provider", "{}", 1.0),
        (day(20), "src_users", "supabase", "signups_by_provider", '{"provider":"old"}', 9.0), (day(30), None, None, "signups", "{}", 7.0),
    ]
    frame = spark.createDataFrame(rows, METRICS.replace("date", "string")).withColumn("day", F.to_date("day"))
    r = of(records.module_records(frame, no_events, tables.sources(spark), *RANGE).collect(), "supabase")
    assert (r["main"]["value"], r["main"]["previous"], r["main"]["delta_label"]) == (6.0, 4.0, "+50.0% vs previous period")
    assert [p["value"] for p in r["sparkline"]] == [2.0, 0, 0, 0, 0, 0, 4.0]
    assert {s["key"]: s["value"] for s in r["secondary"]} == {"users_total": 49.0, "confirmed_users": 0.0, "signups_by_provider": 5.0}
    assert r["insights"][0]["value"] == "email leads with 2 signups in this range."  # of a tie, the first by name


def test_states_stamps_and_modes(spark, no_events):
    sources = tables.sources(spark).withColumn("last_manual_at", F.lit("2024-01-02")).withColumn("last_cron_at", F.lit("2024-01-01"))
    none = spark.createDataFrame([], METRICS)
    rows = records.module_records(none, no_events, sources, *RANGE).collect()
    assert of(rows, "website")["last_sync_at"] == "2024-01-30T10:00:00" and of(rows, "tiktok")["last_sync_at"] == "2024-01-02" and of(rows, "custom_csv")["last_sync_at"] is None
    assert of(rows, "website")["mode_label"] == "Vercel Drain" and of(rows, "website")["setup"]["message"].startswith("Vercel Drain is the active")
    assert of(rows, "instagram")["setup"]["message"] == "Token expired" and of(rows, "shopify")["setup"]["message"] == records.MESSAGES["Disabled", None]
    tracker = records.module_records(none, no_events, sources.where("id <> 'src_drain'"), *RANGE).collect()
    assert of(tracker, "website")["mode_label"] == "Website Tracker" and of(tracker, "website")["setup"]["message"] == records.MESSAGES["Needs credentials", "website"]
    demo = sources.where("id <> 'src_drain'").withColumn("status", F.lit("error")).withColumn("last_error", F.lit(None).cast("string"))
    assert of(records.module_records(none, no_events, demo, *RANGE).collect(), "supabase")["setup"]["message"] == records.SYNC_ERROR
