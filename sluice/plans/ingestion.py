"""Queries of ingestion: deliveries end to end, bounded state, watermarks, cursors, resolved URLs, canonical properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical, urls
from ..operators import cursor
from ..operators.rollup import ROLLUP
from ..sources import connectors, tables
from ..sources.tables import AS_OF, WEB_EVENTS
from ..streaming import bounded, ingest
from .catalogue import ALL_METRICS_SQL, ROLLUP_SQL, query, text_day
from .streams import shared_folder


def _event() -> Column:
    """An event of the log as a vendor would send it; its number in its data tells equal ones apart."""
    view = F.col("event_name") == "page_view"
    fields = {
        "eventType": F.when(view, "pageview").otherwise("custom"), "eventName": F.when(~view, F.col("event_name")), "eventData": F.concat(F.lit('{"id":'), F.col("event_id"), F.lit("}")),
        "timestamp": F.unix_millis(F.col("occurred_at").cast("timestamp")), "sessionId": F.col("session_id"), "deviceId": F.col("anonymous_id"), "path": F.col("path"), "referrer": F.col("referrer"), "country": F.col("country"),
    }
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def bodies(events: DataFrame, group: Column) -> DataFrame:
    """Deliveries of a source's events by group: JSON arrays, and for every third group lines, with one at the end that is broken."""
    rows = events.withColumn("delivery_id", group * 2 + (F.col("source_id") == "src_tracker").cast("int"))
    one = rows.groupBy("delivery_id", "source_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", _event().alias("text")))), lambda x: x["text"]).alias("texts"))
    lines = F.concat(F.array_join("texts", "\n"), F.lit("\n{broken\n"))
    body = F.when(F.floor(F.col("delivery_id") / 2) % 3 == 1, lines).otherwise(F.concat(F.lit("["), F.array_join("texts", ","), F.lit("]")))
    return one.select("delivery_id", "source_id", body.alias("body"))


def delivered(spark, events: DataFrame, batches: int = 3) -> str:
    """The log as deliveries of ten events, taken in by the stream in batches; it is started anew for each.

    From the second batch on, a fifth of the deliveries of the batch before come again as they were, and
    a seventh of its events once more in groups of other sizes. Returns the state folder.
    """
    base = shared_folder(spark)
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    step = 1 if low is None else (high - low) // batches + 1
    step += -step % 10
    of = lambda k: events.where((F.col("event_id") - low >= k * step) & (F.col("event_id") - low < (k + 1) * step))
    ten = F.floor((F.col("event_id") - (low or 0)) / 10)
    for k in range(batches if low is not None else 0):
        part = bodies(of(k), ten)
        if k:
            again = bodies(of(k - 1), ten).where(F.floor(F.col("delivery_id") / 2) % 5 == 0)
            regrouped = bodies(of(k - 1).where(F.col("event_id") % 7 == 0), (10**8 + F.floor(F.col("event_id") / 64)) * 3)
            part = part.unionByName(again).unionByName(regrouped)
        part.write.mode("append").parquet(f"{base}/in")
        ingest.run(spark, f"{base}/in", base, tables.sources)
    return base


@query("stream_deliveries", f"""WITH {ROLLUP_SQL}, low AS (SELECT min(event_id) AS l FROM events), groups AS (SELECT DISTINCT source_id, (event_id - l) // 10 AS g FROM web_events, low)
SELECT day::VARCHAR AS day, source_id, metric_key, dimensions, metric_value FROM metrics_daily UNION ALL SELECT NULL, source_id, 'events_landed', 'suppressed=' || suppressed, count(*)::DOUBLE FROM web_events GROUP BY ALL
UNION ALL SELECT NULL, source_id, 'lines_rejected', NULL, count(*)::DOUBLE FROM groups WHERE g % 3 = 1 GROUP BY ALL""")
def _(spark, sf):
    """Both sinks and the metrics after all batches, repeats among them."""
    base = delivered(spark, tables.web_events(spark, sf))
    count = lambda name, key, dims: ingest.sink(spark, base, name).groupBy("source_id", dims.alias("dimensions")).agg(F.count("*").cast("double").alias("metric_value")).select(F.lit(None).cast("date").alias("day"), "source_id", F.lit(key).alias("metric_key"), "dimensions", "metric_value")
    rows = ingest.metrics(spark, base).drop("dimensions_hash").select("day", "source_id", "metric_key", "dimensions", "metric_value")
    rows = rows.unionByName(count("events", "events_landed", F.concat(F.lit("suppressed="), F.col("suppressed").cast("string")))).unionByName(count("rejects", "lines_rejected", F.lit(None).cast("string")))
    return text_day(rows)


BATCHES = 4


def _landed_in_parts(spark, events: DataFrame, transform) -> DataFrame:
    """The log in ingestion order, a part a batch; the stream is started anew for each, and has passed its watermark on before the next."""
    base = shared_folder(spark)
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    step = 1 if low is None else (high - low) // BATCHES + 1
    for k in range(BATCHES if low is not None else 1):
        part = events if low is None else events.where(F.col("event_id").between(low + k * step, low + (k + 1) * step - 1))
        part.write.mode("append").parquet(f"{base}/log")
        out = bounded.run(spark, f"{base}/log", events.schema, base, transform)
    return out


def _late_sql(days: int) -> str:
    """Each row with its batch's watermark: the latest time of all batches before, less the lateness."""
    return f"""{WEB_EVENTS}, ends AS (SELECT min(event_id) AS low, (max(event_id) - min(event_id)) // {BATCHES} + 1 AS step FROM web_events), parts AS (SELECT w.*, (event_id - low) // step AS part FROM web_events w, ends),
marks AS (SELECT part, max(max(occurred_at)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL {days} DAY AS mark FROM parts GROUP BY part),
judged AS (SELECT p.*, m.mark FROM parts p JOIN marks m ON p.part = m.part)"""


@query("stream_day_windows", f"""WITH {_late_sql(10)} SELECT day::VARCHAR AS day, source_id, event_name, count(*) AS count FROM judged WHERE (mark IS NULL OR day + INTERVAL 1 DAY > mark) AND day + INTERVAL 1 DAY <= (SELECT max(occurred_at) - INTERVAL 10 DAY FROM web_events) GROUP BY ALL""")
def _(spark, sf):
    """Days that the watermark has passed, without the rows that came after it had."""
    e = tables.web_events(spark, sf).select("event_id", "source_id", "event_name", "occurred_at", "day")
    return text_day(_landed_in_parts(spark, e, lambda s: bounded.day_windows(s, "10 days")))


@query("stream_bounded_visitors", f"""WITH {_late_sql(10)} SELECT day::VARCHAR AS day, source_id, count(DISTINCT anonymous_id) AS visitors FROM judged WHERE mark IS NULL OR occurred_at > mark GROUP BY ALL""")
def _(spark, sf):
    """Visitors by day, each counted once, with state for ten days only; late rows count nowhere."""
    e = tables.web_events(spark, sf).select("event_id", "source_id", "anonymous_id", "occurred_at", "day")
    return text_day(_landed_in_parts(spark, e, lambda s: bounded.first_of_day(s, "anonymous_id", "10 days")).groupBy("day", "source_id").agg(F.count("*").alias("visitors")))


@query("incremental_orders", "SELECT o_orderstatus, count(*) AS orders, count(DISTINCT o_orderkey) AS keys, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents, max(o_orderdate)::DATE::VARCHAR AS mark FROM orders GROUP BY 1")
def _(spark, sf):
    """Orders by an order date that grows: a pull of half of them, one that fails, one in which rows of the mark's own day are new, and one with nothing new."""
    base, orders = shared_folder(spark), tables.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    middle = orders.agg(F.percentile_approx("o_orderdate", 0.5)).first()[0]
    early = orders.where((F.col("o_orderdate") < F.lit(middle)) | ((F.col("o_orderdate") == F.lit(middle)) & (F.col("o_orderkey") % 2 == 0)))
    cursor.pull(early, "o_orderdate", "o_orderkey", base)
    cursor.land(orders, "o_orderdate", "o_orderkey", base)  # never committed
    cursor.pull(orders, "o_orderdate", "o_orderkey", base)
    rows = cursor.pull(orders, "o_orderdate", "o_orderkey", base)
    sums = [F.count("*").alias("orders"), F.count_distinct("o_orderkey").alias("keys"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.max("o_orderdate").alias("mark")]
    return text_day(rows.groupBy("o_orderstatus").agg(*sums), "mark")


REFERENCES = ["../a/./b", "?q=1", "#top", "//Other.example/x/../y", "/r/../s//t", "HTTPS://Abs.example:443/a/../b?c", "../../../..", "plain", "", "mailto:x@y"]
_DIR = "list_slice(string_split(p, '/'), 2, len(string_split(p, '/')) - 1)"


@query("url_resolution", f"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS s, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS r, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '[?][^#]*') AS q, page_id % {len(REFERENCES)} AS k FROM pages)
SELECT page_id, CASE k WHEN 0 THEN r || '/' || array_to_string(list_concat(list_slice({_DIR}, 1, len({_DIR}) - 1), ['a', 'b']), '/') WHEN 1 THEN r || p || '?q=1' WHEN 2 THEN r || p || q || '#top' WHEN 3 THEN s || '://other.example/y' WHEN 4 THEN r || '/s//t' WHEN 5 THEN 'https://abs.example/b?c'
WHEN 6 THEN r || '/' WHEN 7 THEN r || '/' || array_to_string(list_concat({_DIR}, ['plain']), '/') WHEN 8 THEN r || p || q ELSE 'mailto:x@y' END AS resolved, CASE WHEN page_id % 4 = 0 THEN r || '/x' WHEN page_id % 4 = 1 THEN r WHEN page_id % 4 = 2 THEN 'https://site.example/x' ELSE 'https://site.example' END AS event_url FROM u""")
def _(spark, sf):
    """References of every kind on every page, and an event's URL by what it has of path, origin and source."""
    k, n = F.col("page_id"), len(REFERENCES)
    root = F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)
    path, base, source = F.when(k % 2 == 0, "y/../x"), F.when(k % 4 < 2, root), F.when(k % 4 == 2, urls.DEFAULT_URL)
    reference = F.element_at(F.array(*map(F.lit, REFERENCES)), (k % n + 1).cast("int"))
    return tables.read(spark, sf, "pages").select("page_id", urls.resolve(reference, F.col("url")).alias("resolved"), urls.event_url(path, base, source).alias("event_url"))


@query("canonical_properties", """SELECT event_id, '{"a":{"k":' || json_extract(props, '$.k') || ',"t":"' || event_type || '","z":[' || user_id || ',{"b":true,"u":"' || user_id || '"}]},"e":' || event_id || '}' AS properties, true AS same, user_id % 2 = 0 AS matched FROM events""")
def _(spark, sf):
    """Each event's nested properties in two orders of keys, which have one canonical text; a number matches as a number only."""
    e = tables.read(spark, sf, "events")
    k, text = F.get_json_object("props", "$.k"), lambda *parts: F.concat(*[F.lit(p) if p[:1] != "$" else F.col(p[1:]).cast("string") for p in parts])
    e = e.withColumn("k", k)
    one = text('{"e": ', "$event_id", ', "a": {"z": [', "$user_id", ', {"u": "', "$user_id", '", "b": true}], "t": "', "$event_type", '", "k": ', "$k", "}}")
    other = text('{"a":{"t":"', "$event_type", '","k":', "$k", ',"z":[', "$user_id", ',{"b":true,"u":"', "$user_id", '"}]},"e":', "$event_id", "}")
    rows = e.select("event_id", "user_id", canonical.canonical_json(one).alias("properties"), (canonical.canonical_hash(one) == canonical.canonical_hash(other)).alias("same"))
    flag = F.when(F.col("user_id") % 2 == 0, '{"even":1}').otherwise('{"even":"1"}')
    hit = canonical.where_dimensions(rows.withColumn("dimensions", flag), {"even": 1}).select(F.col("event_id").alias("hit"))
    return rows.join(hit, F.col("event_id") == F.col("hit"), "left").select("event_id", "properties", "same", F.col("hit").isNotNull().alias("matched"))


def _pulled_users(spark, sf) -> DataFrame:
    """Users in payloads of 50; every seventh is first sent as an unconfirmed user of another provider, and as it is in a later payload, which comes after all retries."""
    u = tables.users(spark, sf)
    seventh = F.col("user_id") % 7 == 0
    fields = lambda provider, sure: F.to_json(F.struct(F.concat(F.lit("u"), F.col("user_id")).alias("id"), F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("created_at"), F.when(sure, "2024-01-30").alias("confirmed_at"), F.struct(provider.alias("provider")).alias("app_metadata")))
    true = fields(F.col("provider"), F.col("confirmed"))
    sent = F.when(seventh, F.array(F.struct(F.lit(0).alias("later"), fields(F.lit("sso"), F.lit(False)).alias("text")), F.struct(F.lit(1).alias("later"), true.alias("text")))).otherwise(F.array(F.struct(F.lit(0).alias("later"), true.alias("text"))))
    rows = u.select((F.col("user_id") / 50).cast("long").alias("g"), F.explode(sent).alias("s")).select((F.col("g") + F.col("s.later") * F.lit(10**13)).alias("payload_id"), "s.text")
    one = rows.groupBy("payload_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list("text"), ","), F.lit("]")).alias("body"))
    return one.select("payload_id", F.lit("src_users").alias("source_id"), F.lit("supabase").alias("kind"), "body")


def _pulled_orders(spark, sf) -> DataFrame:
    """Orders with their lines in payloads of 20."""
    line = F.struct(F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), (F.col("l_returnflag") == "R").alias("returned"))
    lines = tables.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    rows = tables.read(spark, sf, "orders").select("o_orderkey", "o_orderdate").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), "lines"))
    one = rows.groupBy((F.col("o_orderkey") / 20).cast("long").alias("payload_id")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(text), ","), F.lit("]")).alias("body"))
    return one.select("payload_id", F.lit("src_shop").alias("source_id"), F.lit("shopify").alias("kind"), "body")


def mixed_payloads(spark, sf) -> DataFrame:
    """Payloads of all kinds in one table, every fifth sent twice, and some of a kind that has no connector."""
    web = tables.web_events(spark, sf).where("source_id = 'src_drain'")
    drain = bodies(web, F.floor(F.col("event_id") / 10)).select(F.col("delivery_id").alias("payload_id"), "source_id", F.lit("vercel_web_analytics_drain").alias("kind"), "body")
    other = tables.read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("payload_id"), F.lit("src_other").alias("source_id"), F.lit("other").alias("kind"), F.col("n_name").alias("body"))
    rows = drain.unionByName(_pulled_users(spark, sf)).unionByName(_pulled_orders(spark, sf))
    again = F.when(F.col("payload_id") % 5 == 0, F.array(F.lit(0), F.lit(10**12))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("again", F.explode(again)).withColumn("payload_id", F.col("payload_id") + F.col("again")).drop("again").unionByName(other)


_MONEY = "CAST(l_extendedprice AS DECIMAL(18,4))"


@query("connector_bundle", f"""WITH {ALL_METRICS_SQL}, shop AS (SELECT o_orderdate::DATE AS day, count(DISTINCT o_orderkey)::DOUBLE AS orders, coalesce(sum({_MONEY}), 0)::DOUBLE AS gross_sales, coalesce(sum(CAST({_MONEY} * (1 - CAST(l_discount AS DECIMAL(8,4))) AS DECIMAL(18,4))), 0)::DOUBLE AS net_payment, coalesce(sum({_MONEY}) FILTER (WHERE l_returnflag = 'R'), 0)::DOUBLE AS refunds
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), r AS (SELECT day, source_id, 'vercel_web_analytics_drain' AS source_type_key, metric_key, dimensions, metric_value FROM metrics_daily WHERE source_id = 'src_drain'
UNION ALL SELECT day, source_id, 'supabase', metric_key, dimensions, metric_value FROM user_metrics WHERE metric_key IN ('signups', 'signups_by_provider')
UNION ALL SELECT DATE '{AS_OF}', 'src_users', 'supabase', 'users_total', '{ROLLUP}', count(*) FROM users UNION ALL SELECT DATE '{AS_OF}', 'src_users', 'supabase', 'confirmed_users', '{ROLLUP}', count(*) FROM users WHERE confirmed
UNION ALL SELECT day, 'src_shop', 'shopify', metric_key, '{ROLLUP}', metric_value FROM shop UNPIVOT (metric_value FOR metric_key IN (orders, gross_sales, net_payment, refunds)))
SELECT day::VARCHAR AS day, source_id, source_type_key, metric_key, dimensions, sha256(dimensions) AS dimensions_hash, CASE WHEN metric_key IN ('gross_sales', 'net_payment', 'refunds') THEN 'usd' ELSE 'count' END AS unit, metric_value FROM r""")
def _(spark, sf):
    """Drain, user and commerce payloads in one table to their typed metrics, in one pass."""
    return text_day(connectors.normalize(mixed_payloads(spark, sf), AS_OF)[0])


@query("connector_rejects", f"""WITH {WEB_EVENTS}, g AS (SELECT DISTINCT event_id // 10 AS g FROM web_events WHERE source_id = 'src_drain'), x AS (SELECT 'src_drain' AS source_id, 'vercel_web_analytics_drain' AS kind, '{{broken' AS line, CASE WHEN g * 2 % 5 = 0 THEN 2 ELSE 1 END AS n FROM g WHERE g % 3 = 1 UNION ALL SELECT 'src_other', 'other', n_name, 1 FROM nation)
SELECT source_id, kind, line, sum(n)::BIGINT AS payloads FROM x GROUP BY ALL""")
def _(spark, sf):
    """Lines that don't parse and payloads that no connector takes."""
    return connectors.normalize(mixed_payloads(spark, sf), AS_OF)[1].groupBy("source_id", "kind", "line").agg(F.count("*").alias("payloads"))
