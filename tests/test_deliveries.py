"""Drain deliveries: whole, and once."""

from pyspark.sql import functions as F

from sluice.operators import rollup
from sluice.plans import catalogue
from sluice.sources import payloads, tables
from sluice.streaming import rollup as streaming


def test_every_drain_event_is_parsed_and_mapped(spark, small):
    n = tables.web_events(spark, small).where("source_id = 'src_drain'").count()
    mapped = catalogue.queries()["drain_mapping_all"](spark, small)
    assert n > 0 and mapped.count() == mapped.select("properties").distinct().count() == n
    assert catalogue.queries()["drain_body_parse_all"](spark, small).agg({"n": "sum"}).first()[0] == n


VIEW, SALE = '{"eventType":"pageview","timestamp":1,"deviceId":"d","sessionId":"s","path":"/a"}', '{"eventType":"x","eventName":"sale","timestamp":1,"deviceId":"d","sessionId":"s"}'
#: Sent again with the same or another id, grouped anew, and a like event that differs in its path only.
BODIES = [(1, f"[{VIEW},{SALE},{SALE}]"), (1, f"[{VIEW},{SALE},{SALE}]"), (2, f"[{VIEW},{SALE},{SALE}]"), (3, SALE), (4, VIEW.replace("/a", "/b")), (5, "broken"), (6, "broken"), (7, "broken too")]


def log(mapped):
    return mapped.select(F.xxhash64("delivery_id", "position").alias("event_id"), F.lit("src_drain").alias("source_id"), F.lit("2024-01-01").cast("date").alias("day"), F.lit(False).alias("suppressed"), "anonymous_id", "session_id", "event_name", "path", F.lit("").alias("referrer"), "event_key")


def mapped_once(spark, bodies, landed=None):
    return payloads.drain_events(payloads.parse_once(spark.createDataFrame(bodies, "delivery_id long, body string"), landed), F.lit("https://site.example"))


def totals(metrics):
    return {r["metric_key"]: r["metric_value"] for r in metrics.where("metric_key IN ('page_views', 'custom_events', 'sessions')").collect()}


WANT = {"page_views": 2.0, "custom_events": 4.0, "sessions": 2.0}


def test_repeated_deliveries_add_nothing(spark):
    got = mapped_once(spark, BODIES)
    assert sorted((r["delivery_id"], r["position"]) for r in got.collect()) == [(1, 0), (1, 1), (1, 2), (4, 0), (5, 0), (7, 0)]
    assert totals(rollup.daily_rollup(log(got))) == WANT
    assert mapped_once(spark, BODIES, got).count() == 0


def test_repeated_deliveries_add_nothing_to_the_stream(spark, tmp_path):
    for k, bodies in enumerate((BODIES[:2], BODIES[2:5], BODIES[5:], BODIES)):
        log(mapped_once(spark, bodies)).withColumn("event_id", F.col("event_id") + k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        schema = spark.read.parquet(f"{tmp_path}/log").schema
        metrics = streaming.run(spark, f"{tmp_path}/log", schema, f"{tmp_path}/state", key="event_key")
    assert totals(metrics) == WANT
