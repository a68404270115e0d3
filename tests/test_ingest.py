"""Deliveries end to end, their state, bounded streams and cursors."""

import json

import pytest
from pyspark.sql import functions as F

from sluice.operators import cursor, rollup
from sluice.sources import tables
from sluice.streaming import bounded, ingest, state
from sluice.streaming import rollup as stream_rollup


def event(n, day=1, name=None, user=0):
    found = {"eventType": "custom" if name else "pageview", "eventName": name, "timestamp": 1704067200000 + day * 86_400_000 + n, "deviceId": f"d{user}", "sessionId": f"s{user}", "path": f"/{n % 2}"}
    return {k: v for k, v in found.items() if v is not None}


def deliveries(spark, rows):
    return spark.createDataFrame(rows, ingest.DELIVERY)


def values(df):
    return sorted((str(r["day"]), r["source_id"], r["metric_key"], r["dimensions"], r["metric_value"]) for r in df.collect())


def test_state_does_not_grow_with_batches_and_failures_change_nothing(spark, tmp_path, monkeypatch):
    base, made, files = str(tmp_path), [], []
    for n in range(7):
        events = [event(100 * n + k, k % 2, user=k % 3 + n // 4) for k in range(6)]
        made += events
        batch = deliveries(spark, [(n, "src_drain", json.dumps(events)), (100 + n, "src_drain", json.dumps(made[-9:-5]))])
        if n == 3:
            with monkeypatch.context() as m:
                m.setattr(state, "commit", lambda *_: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    ingest.merge(batch, n, base, tables.sources, fan=3)
            assert state.latest(spark, base)[0] == 2
        ingest.merge(batch, n, base, tables.sources, fan=3)
        held = state.latest(spark, base)[1]
        assert all(len(f) < 3 for slots in held.values() for f in slots.values())
        files.append(sum(len(f) for slots in (held["keys"], held["seen"], held["metrics"]) for f in slots.values()))
        before = values(ingest.metrics(spark, base))
        ingest.merge(batch, n, base, tables.sources, fan=3)
        assert values(ingest.metrics(spark, base)) == before
    assert max(files) <= 2 * (2 + 2 + 1) and len(state.names(spark, f"{base}/manifest")) == 2
    log = ingest.sink(spark, base, "events")
    assert log.count() == len(made) == log.select("event_key").distinct().count()
    whole = rollup.daily_rollup(log.withColumn("event_id", F.struct("delivery_id", "position")))
    assert values(ingest.metrics(spark, base)) == values(whole)


def test_odd_bodies_repeats_and_rejects(spark, tmp_path):
    base = str(tmp_path)
    two = [event(1), event(1)]
    no_time = {"eventType": "pageview"}
    first = [(1, "src_drain", json.dumps(two)), (2, "src_drain", json.dumps(two)), (3, "src_drain", None), (4, "src_drain", " "), (5, "src_drain", "{broken"), (6, None, json.dumps(no_time)), (7, "src_tracker", json.dumps(event(2, user=5)))]
    ingest.merge(deliveries(spark, first), 0, base, tables.sources)
    again = [(9, "src_drain", json.dumps(two)), (10, "src_drain", json.dumps(event(1))), (11, "src_drain", "{broken"), (12, "src_drain", f"{json.dumps(event(3, name='sale'))}\n[]")]
    ingest.merge(deliveries(spark, again), 1, base, tables.sources)
    log = sorted((r["delivery_id"], r["event_name"], str(r["day"]), r["suppressed"]) for r in ingest.sink(spark, base, "events").collect())
    assert log == [(1, "page_view", "2024-01-02", False), (1, "page_view", "2024-01-02", False), (6, "page_view", "None", False), (7, "page_view", "2024-01-02", True), (12, "sale", "2024-01-02", False)]
    assert sorted((r["delivery_id"], r["line"]) for r in ingest.sink(spark, base, "rejects").collect()) == [(5, "{broken"), (12, "[]")]
    found = {(d, s, k): v for d, s, k, x, v in values(ingest.metrics(spark, base)) if x == rollup.ROLLUP}
    assert found == {
        ("2024-01-02", "src_drain", "page_views"): 2.0, ("2024-01-02", "src_drain", "custom_events"): 1.0, ("2024-01-02", "src_drain", "unique_visitors"): 1.0, ("2024-01-02", "src_drain", "sessions"): 1.0,
        ("None", None, "page_views"): 1.0, ("None", None, "unique_visitors"): 1.0, ("None", None, "sessions"): 1.0,
    }
    ingest.merge(deliveries(spark, []), 2, base, tables.sources)
    assert state.latest(spark, base)[0] == 2 and ingest.sink(spark, base, "events").count() == 5


def test_identities_are_looked_for_once_and_combine_without_a_sort(spark, tmp_path):
    rows = [(None, 3, "s", "2024-01-01", "a", "x", True), (-5, 2**31 - 1, "s", "2024-01-01", "a", "y", False), (-4, 0, "s", "2024-01-01", "b", "y", True), (2**63 - 1, 1, "s", "2024-01-01", "b", "x", False)]
    events = spark.createDataFrame(rows, "delivery_id long, position int, source_id string, day string, anonymous_id string, session_id string, suppressed boolean")
    events = events.withColumns({"day": F.to_date("day"), "event_name": F.lit("page_view"), "path": F.lit("/"), "referrer": F.lit(None).cast("string"), "event_id": ingest._order()})
    assert [r["delivery_id"] for r in events.orderBy("event_id").collect()] == [None, -5, -4, 2**63 - 1]
    found = []
    stream_rollup.batch_delta(events, spark.createDataFrame([], stream_rollup.SEEN), lambda first: found.append(first) or first)
    assert len(found) == 1 and "SortAggregate" not in found[0]._jdf.queryExecution().executedPlan().toString()
    assert {(r["kind"], r["identity"], r["suppressed"]) for r in found[0].collect()} == {("unique_visitors", "a", True), ("unique_visitors", "b", True), ("sessions", "x", True), ("sessions", "y", False)}


def test_a_cursor_is_committed_with_its_data(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([(k, k // 3, f"v{k}") for k in range(n)] + [(99, None, "no mark")], "id long, at long, v string")
    base = str(tmp_path)
    assert cursor.pull(rows(0), "at", "id", base).count() == 0 and cursor.mark(spark, base) is None
    assert cursor.pull(rows(5), "at", "id", base).count() == 5 and cursor.mark(spark, base) == "1"
    cursor.land(rows(9), "at", "id", base)
    assert cursor.mark(spark, base) == "1" and cursor.landed(spark, base).count() == 5
    got = cursor.pull(rows(9), "at", "id", base)
    assert sorted(r["id"] for r in got.collect()) == list(range(9)) and cursor.mark(spark, base) == "2"
    assert cursor.pull(rows(9), "at", "id", base).count() == 9


def test_late_rows_are_dropped_and_state_is_forgotten(spark, tmp_path):
    of = lambda rows: spark.createDataFrame(rows, "event_id long, source_id string, anonymous_id string, t string").select("event_id", "source_id", "anonymous_id", F.col("t").cast("timestamp").alias("occurred_at"), F.to_date("t").alias("day"))
    parts = [[(1, "s", "a", "2024-01-01 01:00:00"), (2, "s", "a", "2024-01-01 02:00:00"), (3, "s", "b", "2024-01-05 00:00:00")], [(4, "s", "a", "2024-01-01 03:00:00"), (5, "s", "c", "2024-01-04 12:00:00"), (6, "s", "b", "2024-01-05 09:00:00")]]
    for part in parts:
        of(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = bounded.run(spark, f"{tmp_path}/in", of([]).schema, f"{tmp_path}/state", lambda s: bounded.first_of_day(s, "anonymous_id", "1 day"))
    assert sorted((str(r["day"]), r["anonymous_id"]) for r in got.collect()) == [("2024-01-01", "a"), ("2024-01-04", "c"), ("2024-01-05", "b")]
