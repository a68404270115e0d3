"""Fixed cases of the engine's functions, and laws that its sinks and streams must keep."""

import subprocess
import sys
from datetime import date

import pytest
from pyspark.sql import functions as F

from sluice.functions import web
from sluice.operators import reads, rollup, store, sync, validate
from sluice.plans import streams
from sluice.sources import payloads, tables
from sluice.streaming import rollup as streaming

from .conftest import ROOT


@pytest.mark.parametrize(("now", "before", "want"), [(150.0, 100.0, 50.0), (0.0, 0.0, 0.0), (10.0, 0.0, None)])
def test_delta(spark, now, before, want):
    row = spark.createDataFrame([(now, before)], "c double, p double").select(reads.delta(F.col("c"), F.col("p"))).first()
    assert row[0] == want


def test_ranges():
    assert reads.date_range("7d", "2024-01-30") == (date(2024, 1, 24), date(2024, 1, 30))
    assert reads.date_range("nonsense", "2024-01-30")[0] == date(2024, 1, 1)
    assert reads.previous_range(date(2024, 1, 24), date(2024, 1, 30)) == (date(2024, 1, 17), date(2024, 1, 23))


def test_secrets(spark):
    rows = spark.createDataFrame([("abcdefghijklmnopqrstuvw",), ("12345678",), ("",), (None,)], "v string").select(web.mask_secret(F.col("v"))).collect()
    assert [r[0] for r in rows] == ["abcd••••tuvw", "••••", None, None]


METRIC = "day string, source_id string, metric_key string, dimensions string, dimensions_hash string, metric_value double, seq int"


def metric(value, source="s", seq=0, key="k"):
    return ("2024-01-01", source, key, "{}", "h", float(value), seq)


def test_upsert_keeps_the_last_and_increment_adds(spark):
    none = spark.createDataFrame([], METRIC).drop("seq")
    batch = spark.createDataFrame([metric(123), metric(456, seq=1), metric(1, None), metric(2, None, 1)], METRIC)
    rows = store.upsert(none, batch, store.METRIC_KEY, "seq")
    assert sorted((r["source_id"] or "", r["metric_value"]) for r in rows.collect()) == [("", 2.0), ("s", 456.0)]
    again = store.upsert(rows, batch, store.METRIC_KEY, "seq")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    one = spark.createDataFrame([metric(1)], METRIC).drop("seq")
    assert [r["metric_value"] for r in store.increment(store.increment(none, one), one).collect()] == [2.0]


def test_overwriting_days_leaves_others(spark, tmp_path):
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    rows = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "day string, v int")
    store.overwrite_days(rows, f"{tmp_path}/m")
    store.overwrite_days(spark.createDataFrame([("2024-01-02", 3)], "day string, v int"), f"{tmp_path}/m")
    assert sorted((str(r["day"]), r["v"]) for r in spark.read.parquet(f"{tmp_path}/m").collect()) == [("2024-01-01", 1), ("2024-01-02", 3)]


def test_first_seen_by_a_suppressed_event_is_lost(spark):
    e = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "b", False), (4, "b", True)], "event_id long, anonymous_id string, suppressed boolean").withColumns({"source_id": F.lit("s"), "day": F.lit("d")})
    assert [(r["counted"], r["lost"]) for r in rollup.first_seen(e, "anonymous_id").collect()] == [(1, 1)]


def test_arrival_order_does_not_matter_without_suppression(spark, small):
    e = tables.web_events(spark, small).withColumn("suppressed", F.lit(False))
    shuffled = e.withColumn("event_id", -F.col("event_id"))
    assert sorted(map(tuple, rollup.daily_rollup(e).collect())) == sorted(map(tuple, rollup.daily_rollup(shuffled).collect()))


def test_users_and_profiles(spark):
    body = '[{"id":"1","created_at":"2026-04-20T10:00:00Z","confirmed_at":"x"},{"id":"2","created_at":"2026-04-21T10:00:00Z","provider":"google"},{"id":"3","created_at":"2026-04-21T12:00:00Z","email_confirmed_at":"y"}]'
    users = payloads.exploded_users(spark.createDataFrame([(1, body)], "payload_id int, body string"), "2026-04-22")
    got = {(str(r["day"]), r["metric_key"], r["dimensions"]): r["metric_value"] for r in rollup.user_metrics(users).collect()}
    assert got[("2026-04-20", "signups", rollup.ROLLUP)] == 1 and got[("2026-04-21", "signups", rollup.ROLLUP)] == 2
    assert got[("2026-04-21", "users_total", rollup.ROLLUP)] == 3 and got[("2026-04-21", "confirmed_users", rollup.ROLLUP)] == 2
    assert got[("2026-04-21", "signups_by_provider", '{"provider":"google"}')] == 1


def test_drain_bodies(spark):
    data = [(1, ""), (2, '[{"eventType":"pageview"},{"eventType":"x"}]'), (3, '{"eventType":"pageview"}'), (4, '{"eventType":"pageview"}\n{"eventName":"buy","eventData":"plain"}')]
    rows = payloads.parse_bodies(spark.createDataFrame(data, "delivery_id int, body string"))
    assert {r[0]: r[1] for r in rows.groupBy("delivery_id").count().collect()} == {2: 2, 3: 1, 4: 2}
    events = payloads.drain_events(rows, F.lit("https://site.example")).where("delivery_id = 4").orderBy("position").collect()
    assert [e["event_name"] for e in events] == ["page_view", "buy"] and '"raw":"plain"' in events[1]["properties"]
    assert events[0]["external_id"] == "pageview:0:unknown:unknown" and events[0]["url"] == "https://site.example/"


def test_signatures_need_a_secret(spark):
    rows = spark.createDataFrame([("b", None)], "body string, s string")
    assert rows.select(web.verify_signature(F.col("body"), F.col("s"), None)).first()[0] is True


def test_origins(spark):
    data = [(None, "a"), ("x", None), ("x", ""), ("x", "a,x"), ("x", "a")]
    rows = spark.createDataFrame(data, "o string, a string").select(validate.origin_allowed(F.col("o"), F.col("a"))).collect()
    assert [r[0] for r in rows] == [True, True, True, True, False]


def test_held_lease_is_not_given_twice(spark):
    locks = tables.rows(spark, [("s", "a", "2024-01-30T12:04:00")], tables.LOCKS_SCHEMA)
    asked = tables.rows(spark, [(1, "s", "b"), (2, "t", "b"), (3, "t", "c")], tables.REQUESTS_SCHEMA)
    assert [r["acquired"] for r in sync.acquire(locks, asked, tables.NOW).orderBy("seq").collect()] == [False, True, False]


def test_disabled_sources_are_never_due(spark):
    assert "src_shop" not in {r["id"] for r in sync.due(tables.sources(spark), tables.NOW).collect()}


@pytest.mark.parametrize("batches", [1, 7])
def test_stream_equals_batch(spark, small, batches):
    e = tables.web_events(spark, small)
    got, want = streams.rolled_up(spark, e, batches), rollup.daily_rollup(e)
    columns = sorted(want.columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, want.select(columns).collect()), key=str)


def test_watermarked_stream_runs(spark, small, tmp_path):
    tables.web_events(spark, small).write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(tables.web_events(spark, small).schema).parquet(f"{tmp_path}/log")
    query = streaming.watermarked_counts(stream).writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(count) FROM counts").first()[0] == spark.read.parquet(f"{tmp_path}/log").count()


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(date(2024, 1, 5), "s", "page_views", 1.0)], "day date, source_id string, metric_key string, metric_value double").write.parquet(f"{tmp_path}/m")
    frame = reads.list_metrics(spark.read.parquet(f"{tmp_path}/m"), ["page_views"], "s", date(2024, 1, 1), date(2024, 1, 31)).select("metric_value")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(metric_key,page_views)" in plan


def test_entry_works_without_the_training_data_operators():
    code = "import sys; sys.modules['sluice.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'metrics_daily_rollup' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
