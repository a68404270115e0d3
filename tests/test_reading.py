"""The stored typed table, the roll-up's one pass, suppression by rule, and the whole check of an event."""

import shutil
import uuid
from datetime import date

from pyspark.sql import functions as F

from sluice.operators import modules, reads, rollup, validate, warehouse
from sluice.plans import catalogue
from sluice.sources import tables

from .test_platform import plan_of

METRIC = "day date, source_id string, source_type_key string, metric_key string, dimensions string, dimensions_hash string, unit string, metric_value double"
INPUTS = ("events", "customer", "orders")


def test_reads_take_months_and_metrics_in_the_scan(spark, small):
    wanted = {"summary_kpis_30d": "2024-01", "period_delta_30d": "2023-12", "period_delta_7d": "2024-01", "timeseries_page_views_30d": "2024-01", "timeseries_page_views_7d": "2024-01", "provider_leader_30d": "1995-06"}
    for name, month in wanted.items():
        plan = plan_of(catalogue.queries()[name](spark, small))
        assert "events.parquet" not in plan and "typed-metrics" in plan, name
        assert f"(month#" in plan.split("PartitionFilters: [")[1] and f">= {month}" in plan, name
        pushed = plan.split("PushedFilters: [")[1]
        assert "GreaterThanOrEqual(day," in pushed, name
        if name != "summary_kpis_30d":  # it reads several metrics by condition
            assert "metric_key," in pushed.split("ReadSchema")[0], name


def test_the_table_is_made_once_for_a_state_of_its_inputs(spark, small, tmp_path):
    for t in INPUTS:
        shutil.copy(f"{small}/{t}.parquet", tmp_path / f"{t}.parquet")
    files = lambda: {p for r in catalogue.stored(spark, str(tmp_path)).inputFiles() for p in [r]}
    first = files()
    assert first and files() == first
    half = f"{tmp_path}/half"
    spark.read.parquet(f"{small}/events.parquet").where("event_id % 2 = 0").coalesce(1).write.parquet(half)
    shutil.rmtree(tmp_path / "events.parquet", ignore_errors=True) if (tmp_path / "events.parquet").is_dir() else (tmp_path / "events.parquet").unlink()
    shutil.move(half, tmp_path / "events.parquet")
    again = catalogue.stored(spark, str(tmp_path))
    assert not first & set(again.inputFiles())
    fresh = catalogue.all_metrics(spark, str(tmp_path))
    same = ["day", "source_id", "metric_key", "dimensions", "metric_value"]
    assert again.select(same).exceptAll(fresh.select(same)).count() == 0 and again.count() == fresh.count()


def test_a_table_half_written_is_not_read(spark, tmp_path):
    rows = spark.createDataFrame([(date(2024, 1, 2), "s", "website", "page_views", "{}", "h", "count", 1.0), (None, None, None, "page_views", "{}", "h", "count", 2.0)], METRIC)
    source = f"{tmp_path}/in"
    rows.write.parquet(source)
    root = f"{tmp_path}/{uuid.uuid4().hex}"
    warehouse.write(rows.withColumn("metric_value", F.lit(-1.0)), f"{root}/data/left-over")  # a writer that was lost before its entry
    got = warehouse.stored(spark, root, [source], lambda: rows)
    assert sorted(r["metric_value"] for r in got.collect()) == [1.0, 2.0]
    assert [r["metric_value"] for r in reads.list_metrics(got, None, None, date(2024, 1, 1), date(2024, 1, 31), "website").collect()] == [1.0]
    empty = warehouse.stored(spark, f"{root}-empty", [source], lambda: rows.where("false"))
    assert empty.count() == 0 and empty.columns == [*rows.columns, "month"]


def test_rows_in_order(spark):
    rows = [(date(2024, 1, d), s, "website", k, "{}", "h", "count", 1.0) for d in (2, 1) for k in ("b", "a") for s in ("y", None)]
    got = [(r["day"].day, r["metric_key"], r["source_id"]) for r in reads.in_order(spark.createDataFrame(rows, METRIC)).collect()]
    assert got == sorted(got, key=lambda r: (r[0], r[1], r[2] or ""))


def test_rollup_scans_the_log_once(spark, small):
    plan = plan_of(rollup.daily_rollup(tables.web_events(spark, small)))
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 2


def test_rollup_of_nulls_repeats_and_nothing(spark):
    schema = "event_id long, day date, source_id string, event_name string, path string, referrer string, anonymous_id string, session_id string, suppressed boolean"
    day = date(2024, 1, 1)
    rows = [(1, day, None, "page_view", "/", None, None, "s", True), (2, day, None, "page_view", "/", "", None, "s", False), (3, day, None, "buy", None, "r", "a", None, False), (4, None, "x", "page_view", "/", None, "a", "s", False), (4, None, "x", "page_view", "/", None, "a", "s", False)]
    got = {(r["day"], r["source_id"], r["metric_key"], r["dimensions"]): r["metric_value"] for r in rollup.daily_rollup(spark.createDataFrame(rows, schema)).collect()}
    R = rollup.ROLLUP
    assert got == {
        (day, None, "page_views", R): 1, (day, None, "custom_events", R): 1, (day, None, "events_by_path", '{"path":"/"}'): 1, (day, None, "events_by_path", "{}"): 1, (day, None, "events_by_referrer", '{"referrer":"direct"}'): 1, (day, None, "events_by_referrer", '{"referrer":"r"}'): 1,
        (day, None, "unique_visitors", R): 1, (day, None, "sessions", R): 1,  # the null visitor and session s were first seen suppressed
        (None, "x", "page_views", R): 2, (None, "x", "events_by_path", '{"path":"/"}'): 2, (None, "x", "events_by_referrer", '{"referrer":"direct"}'): 2, (None, "x", "unique_visitors", R): 1, (None, "x", "sessions", R): 1,
    }
    assert rollup.daily_rollup(spark.createDataFrame([], schema)).count() == 0


def test_suppression_follows_the_sources(spark):
    e = spark.createDataFrame([("src_tracker", "page_view"), ("src_tracker", "buy"), ("src_drain", "page_view"), (None, "page_view"), ("gone", "page_view")], "source_id string, event_name string")
    marks = lambda s: [r["suppressed"] for r in modules.mark_suppressed(e, s).collect()]
    sources = tables.sources(spark)
    assert sum(marks(sources)) == 1
    assert not any(marks(sources.where("id <> 'src_drain'"))) and not any(marks(sources.where("false")))
    assert not any(marks(sources.withColumn("status", F.when(F.col("id") == "src_drain", "disabled").otherwise(F.col("status")))))


def test_outcomes_of_events(spark):
    ids = {"web": "00000000-0000-4000-8000-000000000001", "drain": "00000000-0000-4000-8000-000000000002", "users": "00000000-0000-4000-8000-000000000003"}
    kinds = [("web", "website", "needs_credentials", "key_w", "https://ok.example"), ("drain", "vercel_web_analytics_drain", "healthy", "key_d", None), ("users", "supabase", "healthy", "key_u", None)]
    sources = spark.createDataFrame([(ids[i], k, i, s, t, o) for i, k, s, t, o in kinds], "id string, type_key string, display_name string, status string, tracking_key string, origins string")
    good = {"anonymous_id": "a", "session_id": "s", "event_name": "buy", "path": "/", "url": "https://ok.example/", "referrer": None, "properties": "{}", "source_id": None, "tracking_key": None, "user_id": None, "user_agent": None, "occurred_at": None, "origin": None, "outcome": "from before"}
    cases = [
        ({}, "accepted", "", None), ({"source_id": ids["web"]}, "accepted", "", ids["web"]), ({"tracking_key": "key_w", "event_name": "page_view"}, "suppressed", "", ids["web"]), ({"tracking_key": "key_d", "event_name": "page_view"}, "accepted", "", ids["drain"]),
        ({"source_id": ids["users"]}, "wrong_kind", "", ids["users"]), ({"source_id": ids["web"], "origin": "https://evil.example"}, "origin", "", ids["web"]), ({"source_id": ids["web"], "origin": "https://ok.example"}, "accepted", "", ids["web"]),
        ({"source_id": ids["drain"], "origin": "https://evil.example"}, "accepted", "", ids["drain"]), ({"source_id": "00000000-0000-4000-8000-00000000000f", "tracking_key": "key_w"}, "accepted", "", "00000000-0000-4000-8000-00000000000f"),
        ({"event_name": "x" * 90, "user_id": "u" * 161}, "invalid", "event_name,user_id", None), ({"properties": '{"a":"' + "x" * 9000 + '"}'}, "invalid", "properties", None), ({"properties": "[" + "1," * 5000 + "1]"}, "invalid", "properties", None), ({"anonymous_id": None, "occurred_at": "soon"}, "invalid", "anonymous_id,occurred_at", None),
    ]
    events = spark.createDataFrame([(k, *{**good, **c[0]}.values()) for k, c in enumerate(cases)], "k int, " + ", ".join(f"{c} string" for c in good))
    got = {r["k"]: (r["outcome"], r["problems"], r["resolved_id"]) for r in validate.admitted(events, sources).collect()}
    assert got == {k: tuple(c[1:]) for k, c in enumerate(cases)}
    assert validate.admitted(events.where("false"), sources).count() == 0
