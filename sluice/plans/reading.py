"""Queries of the stored typed table, of suppression by rule, and of the whole check of an event."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import modules, reads, rollup, validate
from ..sources import tables
from ..sources.tables import SOURCES_SQL, WEB_EVENTS
from .catalogue import ROLLUP_SQL, query, stored, text_day
from .platform import CHOSEN_SQL, TYPED_SQL


@query("metrics_of_type", f"WITH {TYPED_SQL} SELECT day::VARCHAR AS day, source_id, source_type_key, metric_key, dimensions, unit, metric_value FROM typed WHERE source_type_key = 'supabase' AND metric_key IN ('signups', 'users_total') AND day BETWEEN '1995-03-20' AND '1995-06-10'")
def _(spark, sf):
    """A source kind's rows of a range that spans months, in order."""
    rows = reads.list_metrics(stored(spark, sf), ["signups", "users_total"], None, date(1995, 3, 20), date(1995, 6, 10), "supabase")
    return text_day(reads.in_order(rows).drop("dimensions_hash", "month"))


NO_DRAIN_SQL = SOURCES_SQL.replace("sources(", "given(", 1) + ", sources AS (SELECT * REPLACE (CASE WHEN type_key = 'vercel_web_analytics_drain' THEN 'disabled' ELSE status END AS status) FROM given)"


def _by_rule(sources_sql: str) -> str:
    """The roll-up's SQL over the log with each event's suppression by rule instead of the log's own."""
    rule = f"""{sources_sql}, {CHOSEN_SQL}, web_events AS (SELECT w.* REPLACE (coalesce(s.type_key = 'website' AND w.event_name = 'page_view' AND (SELECT count(*) FROM prim p WHERE p.id <> s.id AND p.type_key = 'vercel_web_analytics_drain') > 0, false) AS suppressed) FROM logged w LEFT JOIN sources s ON s.id = w.source_id)"""
    return f"{WEB_EVENTS.replace('web_events AS', 'logged AS', 1)}, {rule}, {ROLLUP_SQL[len(WEB_EVENTS) + 2 :]}"


@query("rollup_without_drain", f"WITH {_by_rule(NO_DRAIN_SQL)} SELECT day::VARCHAR AS day, source_id, metric_key, dimensions, dimensions_hash, metric_value FROM metrics_daily")
def _(spark, sf):
    """The roll-up once the drain is disabled: the rule suppresses nothing, and the tracker's page views count."""
    status = F.when(F.col("type_key") == "vercel_web_analytics_drain", "disabled").otherwise(F.col("status"))
    sources = tables.sources(spark).withColumn("status", status)
    return text_day(rollup.daily_rollup(modules.mark_suppressed(tables.web_events(spark, sf), sources)))


#: An id as a UUID, in Spark and in SQL.
UUID_OF = "regexp_replace(md5({}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '{}')"
UUID_SQL, UUID_SPARK = (lambda c: UUID_OF.format(c, r"\1-\2-\3-\4-\5")), (lambda c: F.expr(UUID_OF.format(c, "$1-$2-$3-$4-$5")))


def sources_by_uuid(spark) -> DataFrame:
    return tables.sources(spark).withColumn("id", UUID_SPARK("id"))


def incoming(spark, sf) -> DataFrame:
    """Events as a tracker sends them: sources by id, by key or not at all, origins, and faults in every field."""
    k = F.col("event_id")
    each = lambda n, value, other: F.when(k % n == 0, value).otherwise(other)
    long = lambda c, n: F.repeat(F.lit(c), n.cast("int"))
    text = lambda c: F.lit(c).cast("string")
    given: Column = F.when(k % 5 == 0, UUID_SPARK("source_id")).when(k % 5 == 2, UUID_SPARK("'src_users'")).when(k % 35 == 3, F.lit("src_tracker")).when(k % 35 == 8, UUID_SPARK("'src_gone'"))
    key = F.when(k % 5 == 1, F.when(F.col("source_id") == "src_drain", "key_drain_0001").otherwise("key_tracker_0002")).when(k % 35 == 13, "key")
    return tables.web_events(spark, sf).select(
        "event_id", given.alias("source_id"), key.alias("tracking_key"), each(29, long("a", 158 + k % 4), F.col("anonymous_id")).alias("anonymous_id"), each(31, "", F.col("session_id")).alias("session_id"),
        each(11, "has space", F.col("event_name")).alias("event_name"), each(37, long("/", 498 + k % 5), F.col("path")).alias("path"), each(17, "not a url", F.concat(F.lit("https://site.example"), F.col("path"))).alias("url"), each(41, long("r", 1198 + k % 5), F.col("referrer")).alias("referrer"),
        each(43, long("u", 158 + k % 5), text(None)).alias("user_id"), each(47, long("m", 998 + k % 5), text(None)).alias("user_agent"), each(23, F.when(k % 2 == 0, "yesterday").otherwise("2024-01-02T03:04:05Z"), text(None)).alias("occurred_at"),
        each(19, F.concat(F.lit('{"p":"'), long("é", 4090 + k % 8), F.lit('"}')), F.when(k % 53 == 0, "[1]").otherwise("{}")).alias("properties"), F.when(k % 3 == 0, "https://site.example").when(k % 3 == 1, "https://evil.example").alias("origin"),
    )


INCOMING_SQL = f"""incoming AS (SELECT event_id, event_name AS sent_name, CASE WHEN k % 5 = 0 THEN {UUID_SQL('source_id')} WHEN k % 5 = 2 THEN {UUID_SQL("'src_users'")} WHEN k % 35 = 3 THEN 'src_tracker' WHEN k % 35 = 8 THEN {UUID_SQL("'src_gone'")} END AS source_id,
CASE WHEN k % 5 = 1 THEN CASE WHEN source_id = 'src_drain' THEN 'key_drain_0001' ELSE 'key_tracker_0002' END WHEN k % 35 = 13 THEN 'key' END AS tracking_key, CASE WHEN k % 29 = 0 THEN repeat('a', (158 + k % 4)::INT) ELSE anonymous_id END AS anonymous_id, CASE WHEN k % 31 = 0 THEN '' ELSE session_id END AS session_id,
CASE WHEN k % 11 = 0 THEN 'has space' ELSE event_name END AS event_name, CASE WHEN k % 37 = 0 THEN repeat('/', (498 + k % 5)::INT) ELSE path END AS path, CASE WHEN k % 17 = 0 THEN 'not a url' ELSE 'https://site.example' || path END AS url, CASE WHEN k % 41 = 0 THEN repeat('r', (1198 + k % 5)::INT) ELSE referrer END AS referrer,
CASE WHEN k % 43 = 0 THEN repeat('u', (158 + k % 5)::INT) END AS user_id, CASE WHEN k % 47 = 0 THEN repeat('m', (998 + k % 5)::INT) END AS user_agent, CASE WHEN k % 23 = 0 THEN CASE WHEN k % 2 = 0 THEN 'yesterday' ELSE '2024-01-02T03:04:05Z' END END AS occurred_at,
CASE WHEN k % 19 = 0 THEN '{{"p":"' || repeat('é', (4090 + k % 8)::INT) || '"}}' WHEN k % 53 = 0 THEN '[1]' ELSE '{{}}' END AS properties, CASE k % 3 WHEN 0 THEN 'https://site.example' WHEN 1 THEN 'https://evil.example' END AS origin FROM (SELECT *, event_id AS k FROM web_events))"""
CHECKS_SQL = [
    ("anonymous_id", "length(anonymous_id) NOT BETWEEN 1 AND 160"), ("session_id", "length(session_id) NOT BETWEEN 1 AND 160"), ("event_name", "length(event_name) NOT BETWEEN 1 AND 80 OR NOT regexp_full_match(event_name, '[a-zA-Z0-9_.:-]+')"), ("path", "length(path) NOT BETWEEN 1 AND 500"),
    ("url", "length(url) > 1200 OR NOT starts_with(url, 'https://')"), ("referrer", "length(referrer) > 1200"), ("properties", "octet_length(encode(properties)) > 8192 OR json_type(properties) <> 'OBJECT'"), ("source_id", "source_id IS NOT NULL AND try_cast(source_id AS UUID) IS NULL"),
    ("tracking_key", "length(tracking_key) NOT BETWEEN 4 AND 120"), ("user_id", "length(user_id) > 160"), ("user_agent", "length(user_agent) > 1000"), ("occurred_at", "occurred_at IS NOT NULL AND try_cast(occurred_at AS TIMESTAMPTZ) IS NULL"),
]
ADMITTED_SQL = f"""{WEB_EVENTS}, {SOURCES_SQL}, {CHOSEN_SQL}, {INCOMING_SQL}, by_uuid AS (SELECT * REPLACE ({UUID_SQL('id')} AS id), id AS plain_id FROM sources),
judged AS (SELECT *, string_split(concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in CHECKS_SQL)}), ',') AS failed FROM incoming),
checked AS (SELECT i.*, coalesce(i.source_id, b.id) AS resolved_id, coalesce(a.type_key, b.type_key) AS kind, coalesce(a.origins, b.origins) AS origins, coalesce(a.plain_id, b.plain_id) AS plain_id
FROM judged i LEFT JOIN by_uuid a ON a.id = i.source_id LEFT JOIN by_uuid b ON i.source_id IS NULL AND b.tracking_key = i.tracking_key),
admitted AS (SELECT *, array_to_string(list_sort(failed), ',') AS problems, CASE WHEN failed <> [''] THEN 'invalid' WHEN kind NOT IN ('website', 'vercel_web_analytics_drain') THEN 'wrong_kind' WHEN origin IS NOT NULL AND origins <> '' AND NOT list_contains(string_split(origins, ','), origin) THEN 'origin'
WHEN kind = 'website' AND event_name = 'page_view' AND (SELECT count(*) FROM prim WHERE id <> plain_id AND type_key = 'vercel_web_analytics_drain') > 0 THEN 'suppressed' ELSE 'accepted' END AS outcome FROM checked)"""


@query("event_admission", f"WITH {ADMITTED_SQL} SELECT event_id, problems, resolved_id, kind AS resolved_type, outcome FROM admitted")
def _(spark, sf):
    """All checks of each event at once, and what becomes of it."""
    rows = validate.admitted(incoming(spark, sf), sources_by_uuid(spark))
    return rows.select("event_id", F.array_join(F.array_sort(F.split("problems", ",")), ",").alias("problems"), "resolved_id", "resolved_type", "outcome")


@query("event_admission_by_source", f"WITH {ADMITTED_SQL} SELECT coalesce(plain_id, 'none') AS source, outcome, count(*) AS events, count(DISTINCT anonymous_id) AS visitors FROM admitted GROUP BY ALL")
def _(spark, sf):
    """How many events and visitors of each source were taken, and why the others were not."""
    names = tables.sources(spark).select(UUID_SPARK("id").alias("uuid"), F.col("id").alias("name"))
    rows = validate.admitted(incoming(spark, sf), sources_by_uuid(spark)).join(F.broadcast(names), F.col("resolved_id") == F.col("uuid"), "left")
    return rows.groupBy(F.coalesce("name", F.lit("none")).alias("source"), "outcome").agg(F.count("*").alias("events"), F.count_distinct("anonymous_id").alias("visitors"))
