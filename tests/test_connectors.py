"""Mixed payloads beyond their queries: what counts once, what is refused, what is empty."""

import pytest

from sluice.sources import connectors

SCHEMA = "payload_id long, source_id string, kind string, body string"
DAY = "2024-01-30"


def metrics(spark, rows, schema=SCHEMA):
    found, rejects = connectors.normalize(spark.createDataFrame(rows, schema), DAY)
    values = {(r["source_id"], str(r["day"]), r["metric_key"], r["dimensions"] if "by_" in r["metric_key"] else ""): r["metric_value"] for r in found.collect()}
    return values, sorted((r["payload_id"], r["position"], r["line"]) for r in rejects.collect())


def test_the_newest_record_of_an_id_counts(spark):
    old, new = '[{"id":"a","created_at":"2024-01-01T00:00:00Z"},{"id":"b","confirmed_at":"x"}]', '{"data":{"record":{"id":"a","created_at":"2024-01-02T00:00:00Z","provider":"google","confirmed_at":"x"}}}'
    got, rejects = metrics(spark, [(2, "s", "supabase", new), (1, "s", "supabase", old), (1, "t", "supabase", old)])
    assert rejects == [] and got["s", DAY, "users_total", ""] == 2 and got["s", DAY, "confirmed_users", ""] == 2 and got["t", DAY, "confirmed_users", ""] == 1
    assert got["s", "2024-01-02", "signups", ""] == 1 and ("s", "2024-01-01", "signups", "") not in got
    assert got["s", "2024-01-02", "signups_by_provider", '{"provider":"google"}'] == 1 and got["s", DAY, "signups_by_provider", '{"provider":"email"}'] == 1


def test_events_count_as_often_as_one_payload_has_them(spark):
    view = '{"eventType":"pageview","path":"/a","deviceId":"d","timestamp":0}'
    got, _ = metrics(spark, [(1, "s", "vercel_web_analytics_drain", f"[{view},{view},{view}]"), (2, "s", "vercel_web_analytics_drain", f"{view}\n{view}"), (3, "s", "vercel_web_analytics_drain", "{}")])
    assert got["s", "1970-01-01", "page_views", ""] == 3 and got["s", "1970-01-01", "unique_visitors", ""] == 1 and got["s", DAY, "custom_events", ""] == 1
    assert got["s", "1970-01-01", "events_by_path", '{"path":"/a"}'] == 3 and got["s", DAY, "events_by_referrer", '{"referrer":"direct"}'] == 1


def test_orders_are_exact_and_may_have_no_lines(spark):
    body = '[{"id":"1","created_at":"2024-01-05","lines":[{"price":0.1,"discount":0.5},{"price":0.2,"returned":true},{"discount":0.1}]},{"id":"2","created_at":"2024-01-05"},{"created_at":"2024-01-05"}]'
    got, rejects = metrics(spark, [(1, "s", "shopify", body)])
    at = lambda key: got["s", "2024-01-05", key, ""]
    assert (at("orders"), at("gross_sales"), at("net_payment"), at("refunds")) == (2, 0.3, 0.25, 0.2)
    assert rejects == [(1, 2, '{"created_at":"2024-01-05"}')]


def test_refused_and_empty_payloads(spark):
    rows = [(1, "s", "nobody", "x"), (2, None, None, "y"), (3, "s", "supabase", "not json"), (4, "s", "shopify", '{"id":"1"}'), (5, "s", "supabase", "[]"), (6, "s", "vercel_web_analytics_drain", None), (7, "s", "shopify", " \n"), (8, "s", "supabase", '[{"id":"a"}] tail'), (9, "s", "nobody", None)]
    got, rejects = metrics(spark, rows)
    assert got == {} and [r[0] for r in rejects] == [1, 2, 3, 4, 8]
    assert metrics(spark, []) == ({}, [])
    clash = "payload_id long, source_id string, kind string, body string, key string, facts string, ok boolean, position int"
    assert metrics(spark, [(1, "s", "supabase", '[{"id":"a"}]', "k", "f", False, 9)], clash)[0]["s", DAY, "users_total", ""] == 1


def test_connectors_by_kind():
    assert connectors.connector("shopify").has_ids and len({c.kind for c in connectors.REGISTRY}) == len(connectors.REGISTRY)
    with pytest.raises(ValueError):
        connectors.connector("nobody")


def test_mixed_payloads_are_scanned_once(spark, tmp_path):
    spark.createDataFrame([(1, "s", "supabase", '[{"id":"a"}]')], SCHEMA).write.parquet(f"{tmp_path}/raw")
    plan = connectors.normalize(spark.read.parquet(f"{tmp_path}/raw"), DAY)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan


def test_records_are_made_as_columns_and_not_inside_the_array(spark, tmp_path):
    spark.createDataFrame([(1, "s", "supabase", '[{"id":"a"}]')], SCHEMA).write.parquet(f"{tmp_path}/raw")
    for part in connectors.normalize(spark.read.parquet(f"{tmp_path}/raw"), DAY):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        cut = plan[plan.index("Generate posexplode") : plan.index("Relation [")]
        assert "startswith" in cut.lower() and "sha2(" not in cut and "signups" not in cut
