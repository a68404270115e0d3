"""The engine's queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import web
from ..operators import modules, reads, rollup, store, sync, validate, warehouse
from ..sources import payloads, tables
from ..sources.tables import AS_OF, LOCKS_SQL, NOW, REQUESTS_SQL, RUNS_SQL, SOURCES_SQL, USERS, WEB_EVENTS
from . import streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def text_day(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd") for n in names or ("day",)})


# The roll-up in SQL: counters, then identities whose first event of the day is not suppressed.
ROLLUP_SQL = f"""{WEB_EVENTS}, live AS (SELECT * FROM web_events WHERE NOT suppressed), counts AS (
  SELECT day, source_id, CASE WHEN event_name = 'page_view' THEN 'page_views' ELSE 'custom_events' END AS metric_key, '{rollup.ROLLUP}' AS dimensions, count(*)::DOUBLE AS metric_value FROM live GROUP BY ALL
  UNION ALL SELECT day, source_id, 'events_by_path', '{{"path":"' || path || '"}}', count(*) FROM live GROUP BY ALL
  UNION ALL SELECT day, source_id, 'events_by_referrer', '{{"referrer":"' || coalesce(nullif(referrer, ''), 'direct') || '"}}', count(*) FROM live GROUP BY ALL
  UNION ALL SELECT day, source_id, 'unique_visitors', '{rollup.ROLLUP}', count(*) FROM (SELECT day, source_id, arg_min(suppressed, event_id) AS s FROM web_events GROUP BY day, source_id, anonymous_id) WHERE NOT s GROUP BY ALL
  UNION ALL SELECT day, source_id, 'sessions', '{rollup.ROLLUP}', count(*) FROM (SELECT day, source_id, arg_min(suppressed, event_id) AS s FROM web_events GROUP BY day, source_id, session_id) WHERE NOT s GROUP BY ALL),
metrics_daily AS (SELECT *, sha256(dimensions) AS dimensions_hash FROM counts)"""
USER_METRICS_SQL = f"""{USERS}, per_day AS (SELECT day, count(*) AS n, count(*) FILTER (WHERE confirmed) AS c FROM users GROUP BY 1), user_metrics AS (
  SELECT day, 'src_users' AS source_id, 'signups' AS metric_key, '{rollup.ROLLUP}' AS dimensions, n::DOUBLE AS metric_value FROM per_day
  UNION ALL SELECT day, 'src_users', 'users_total', '{rollup.ROLLUP}', (sum(n) OVER (ORDER BY day))::DOUBLE FROM per_day
  UNION ALL SELECT day, 'src_users', 'confirmed_users', '{rollup.ROLLUP}', (sum(c) OVER (ORDER BY day))::DOUBLE FROM per_day
  UNION ALL SELECT day, 'src_users', 'signups_by_provider', '{{"provider":"' || provider || '"}}', count(*) FROM users GROUP BY day, provider)"""
ALL_METRICS_SQL = f"{ROLLUP_SQL}, {USER_METRICS_SQL}, all_metrics AS (SELECT day, source_id, metric_key, dimensions, metric_value FROM metrics_daily UNION ALL SELECT * FROM user_metrics)"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.daily_rollup(modules.mark_suppressed(tables.web_events(spark, sf_dir), tables.sources(spark)))


def all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).unionByName(rollup.user_metrics(tables.users(spark, sf_dir)))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed metrics of all sources as they are stored; rolled up only if the inputs have changed since."""
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("events", "customer", "orders")]
    return warehouse.stored(spark, f"{streams.shared_base(spark)}/typed-metrics", inputs, lambda: modules.typed(all_metrics(spark, sf_dir), tables.sources(spark)))


# Roll-ups


@query("metrics_daily_rollup", f"WITH {ROLLUP_SQL} SELECT day::VARCHAR AS day, source_id, metric_key, dimensions, dimensions_hash, metric_value FROM metrics_daily")
def _(spark, sf):
    return text_day(metrics(spark, sf))


def _slice(name: str, key: str) -> None:
    @query(name, f"WITH {ROLLUP_SQL} SELECT day::VARCHAR AS day, source_id, dimensions, metric_value FROM metrics_daily WHERE metric_key = '{key}'")
    def _(spark, sf):
        return text_day(metrics(spark, sf).where(F.col("metric_key") == key).select("day", "source_id", "dimensions", "metric_value"))


for _name, _key in (("events_by_path_daily", "events_by_path"), ("events_by_referrer_daily", "events_by_referrer"), ("unique_visitors_daily", "unique_visitors"), ("sessions_daily", "sessions")):
    _slice(_name, _key)


@query("first_seen_suppressed", f"""WITH {WEB_EVENTS} SELECT day::VARCHAR AS day, source_id, count(*) FILTER (WHERE NOT s) AS counted, count(*) FILTER (WHERE s) AS lost
FROM (SELECT day, source_id, arg_min(suppressed, event_id) AS s FROM web_events GROUP BY day, source_id, anonymous_id) GROUP BY ALL""")
def _(spark, sf):
    return text_day(rollup.first_seen(tables.web_events(spark, sf), "anonymous_id"))


@query("dimension_hash", f"WITH {ROLLUP_SQL} SELECT DISTINCT metric_key, dimensions, dimensions_hash FROM metrics_daily")
def _(spark, sf):
    """Canonical JSON of a map in any key order, and its hash."""
    rows = metrics(spark, sf).select("metric_key", "dimensions").distinct()
    return rows.select("metric_key", rollup.canonical(F.from_json("dimensions", "map<string,string>")).alias("dimensions")).withColumn("dimensions_hash", F.sha2("dimensions", 256))


# Reads


def _series(days: str) -> None:
    start, end = reads.date_range(days, AS_OF)

    @query(f"timeseries_page_views_{days}", f"""WITH {ROLLUP_SQL} SELECT d::DATE::VARCHAR AS day, coalesce(v, 0)::DOUBLE AS metric_value FROM generate_series(DATE '{start}', DATE '{end}', INTERVAL 1 DAY) g(d)
LEFT JOIN (SELECT day, sum(metric_value) AS v FROM metrics_daily WHERE metric_key = 'page_views' GROUP BY 1) ON day = d::DATE""")
    def _(spark, sf):
        return text_day(reads.dense_series(stored(spark, sf), "page_views", start, end))


DELTA_KEYS = ["page_views", "unique_visitors", "custom_events", "sessions", "signups"]


def _delta_sql(start, end) -> str:
    before = reads.previous_range(start, end)
    return f"""SELECT metric_key, coalesce(sum(metric_value) FILTER (WHERE day >= '{start}'), 0)::DOUBLE AS current_value, coalesce(sum(metric_value) FILTER (WHERE day < '{start}'), 0)::DOUBLE AS previous_value
FROM all_metrics WHERE metric_key IN ({', '.join(repr(k) for k in DELTA_KEYS)}) AND day BETWEEN '{before[0]}' AND '{end}' GROUP BY 1"""


DELTA_CASE = "CASE WHEN previous_value = 0 THEN CASE WHEN current_value = 0 THEN 0.0 END ELSE round((current_value - previous_value) / previous_value * 100, 6) END::DOUBLE AS delta_percent"


def _delta(days: str) -> None:
    start, end = reads.date_range(days, AS_OF)

    @query(f"period_delta_{days}", f"WITH {ALL_METRICS_SQL} SELECT *, {DELTA_CASE} FROM ({_delta_sql(start, end)})")
    def _(spark, sf):
        return reads.period_delta(stored(spark, sf), DELTA_KEYS, start, end)


for _days in ("30d", "7d"):
    _series(_days)
    _delta(_days)


MODES = [("page_views", "sum"), ("unique_visitors", "sum"), ("sessions", "sum"), ("custom_events", "sum"), ("signups", "sum"), ("users_total", "latest"), ("confirmed_users", "latest"), ("video_views", "sum")]


@query("module_metrics_sum_latest", f"""WITH {ALL_METRICS_SQL}, {tables.values('modes', MODES, 'metric_key string, mode string')}
SELECT m.metric_key, m.mode, coalesce(CASE WHEN mode = 'latest' THEN l ELSE s END, 0)::DOUBLE AS metric_value FROM modes m
LEFT JOIN (SELECT metric_key, sum(metric_value) AS s, arg_max(metric_value, (day, source_id, dimensions)) AS l FROM all_metrics GROUP BY 1) a ON a.metric_key = m.metric_key""")
def _(spark, sf):
    return reads.by_mode(stored(spark, sf), tables.rows(spark, MODES, "metric_key string, mode string"))


@query("summary_kpis_30d", f"""WITH {ALL_METRICS_SQL}, {SOURCES_SQL}, {RUNS_SQL}, r AS (SELECT * FROM all_metrics WHERE day BETWEEN '2024-01-01' AND '2024-01-30')
SELECT k AS kpi, coalesce(sum(metric_value), 0)::DOUBLE AS value_num, NULL::VARCHAR AS value_str FROM (VALUES ('page_views'), ('unique_visitors'), ('custom_events'), ('signups')) t(k) LEFT JOIN r ON metric_key = k GROUP BY k
UNION ALL SELECT 'users_total', max(metric_value), NULL FROM r WHERE metric_key = 'users_total'
UNION ALL SELECT 'active_sources', count(*)::DOUBLE, NULL FROM sources WHERE status <> 'disabled'
UNION ALL SELECT 'last_sync_status', NULL, coalesce(arg_max(status, (created_at, id)), 'none') FROM sync_runs
UNION ALL SELECT 'sync_errors', count(*) FILTER (WHERE status = 'error')::DOUBLE, NULL FROM (SELECT * FROM sync_runs ORDER BY created_at DESC, id DESC LIMIT 40)""")
def _(spark, sf):
    """KPIs of a range; users_total over no rows is null."""
    start, end = reads.date_range("30d", AS_OF)
    m = reads.list_metrics(stored(spark, sf), None, None, start, end)
    keys = ["page_views", "unique_visitors", "custom_events", "signups"]
    sums = [F.coalesce(F.sum(F.when(F.col("metric_key") == k, F.col("metric_value"))), F.lit(0.0)).alias(k) for k in keys]
    one = m.agg(*sums, F.max(F.when(F.col("metric_key") == "users_total", F.col("metric_value"))).alias("users_total"))
    num = lambda k: F.struct(F.lit(k).alias("kpi"), F.col(k).cast("double").alias("value_num"), F.lit(None).cast("string").alias("value_str"))
    facts = one.select(F.explode(F.array(*[num(k) for k in [*keys, "users_total"]])).alias("x")).select("x.*")
    runs = tables.sync_runs(spark).orderBy(F.desc("created_at"), F.desc("id")).limit(40)
    state = runs.agg(F.count_if(F.col("status") == "error").alias("sync_errors"), F.coalesce(F.max_by("status", F.struct("created_at", "id")), F.lit("none")).alias("last"))
    active = tables.sources(spark).agg(F.count_if(F.col("status") != "disabled").alias("active_sources"))
    text = F.struct(F.lit("last_sync_status").alias("kpi"), F.lit(None).cast("double").alias("value_num"), F.col("last").alias("value_str"))
    return facts.unionByName(state.select(F.explode(F.array(num("sync_errors"), text)).alias("x")).select("x.*")).unionByName(active.select(num("active_sources").alias("x")).select("x.*"))


@query("source_comparison", f"""WITH {ALL_METRICS_SQL} SELECT coalesce(source_id, 'none') AS source, {', '.join(f"coalesce(sum(metric_value) FILTER (WHERE metric_key = '{k}'), 0)::DOUBLE AS {k}" for k in ('page_views', 'signups', 'custom_events'))} FROM all_metrics GROUP BY 1""")
def _(spark, sf):
    return reads.source_comparison(stored(spark, sf))


def _top(name: str, column: str, fallback: str) -> None:
    @query(f"top_{name}", f"""WITH {WEB_EVENTS} SELECT coalesce(nullif({column}, ''), '{fallback}') AS label, count(*) AS n FROM (SELECT * FROM web_events WHERE source_id = 'src_drain' ORDER BY occurred_at DESC, event_id DESC LIMIT 2000)
GROUP BY 1 ORDER BY n DESC, max((occurred_at, event_id)) DESC LIMIT 1""")
    def _(spark, sf):
        return reads.top_entry(tables.web_events(spark, sf).where(F.col("source_id") == "src_drain"), column, fallback)


for _args in (("page", "path", "/"), ("referrer", "referrer", "direct"), ("country", "country", "Unknown"), ("device", "device_type", "Unknown")):
    _top(*_args)


@query("provider_leader", f"WITH {USERS} SELECT provider, count(*)::DOUBLE AS signups FROM users GROUP BY 1 ORDER BY signups DESC, provider LIMIT 1")
def _(spark, sf):
    m = rollup.user_metrics(tables.users(spark, sf)).where(F.col("metric_key") == "signups_by_provider")
    provider = F.coalesce(F.get_json_object("dimensions", "$.provider"), F.lit("unknown"))
    return m.groupBy(provider.alias("provider")).agg(F.sum("metric_value").alias("signups")).orderBy(F.desc("signups"), "provider").limit(1)


@query("recent_events_30_by_path", f"WITH {WEB_EVENTS} SELECT path, count(*) AS n FROM (SELECT path FROM web_events ORDER BY occurred_at DESC, event_id DESC LIMIT 30) GROUP BY 1")
def _(spark, sf):
    return reads.newest(tables.web_events(spark, sf), 30).groupBy("path").agg(F.count("*").alias("n"))


@query("recent_events_100", f"WITH {WEB_EVENTS} SELECT event_id, event_name, path, source_id FROM web_events ORDER BY occurred_at DESC, event_id DESC LIMIT 100")
def _(spark, sf):
    return reads.newest(tables.web_events(spark, sf), 100).select("event_id", "event_name", "path", "source_id")


@query("find_events_window", f"""WITH {WEB_EVENTS} SELECT event_id, source_id, event_name, path FROM web_events WHERE source_id = 'src_drain' AND occurred_at >= '2024-01-10' AND occurred_at < '2024-01-12' ORDER BY occurred_at DESC, event_id DESC LIMIT 500""")
def _(spark, sf):
    at = F.col("occurred_at")
    rows = tables.web_events(spark, sf).where((F.col("source_id") == "src_drain") & (at >= F.lit("2024-01-10").cast("timestamp_ntz")) & (at < F.lit("2024-01-12").cast("timestamp_ntz")))
    return reads.newest(rows, 500).select("event_id", "source_id", "event_name", "path")


@query("list_metrics_filtered", f"WITH {ROLLUP_SQL} SELECT day::VARCHAR AS day, source_id, metric_key, dimensions, metric_value FROM metrics_daily WHERE metric_key IN ('page_views', 'sessions') AND source_id = 'src_drain' AND day BETWEEN '2024-01-05' AND '2024-01-20'")
def _(spark, sf):
    start, end = reads.date_range("7d", "2024-01-20")
    rows = reads.list_metrics(stored(spark, sf), ["page_views", "sessions"], "src_drain", start - timedelta(days=9), end)
    return text_day(rows.select("day", "source_id", "metric_key", "dimensions", "metric_value"))


@query("metrics_dimension_filter", f"""WITH {ROLLUP_SQL} SELECT coalesce(sum(metric_value), 0)::DOUBLE AS metric_value FROM metrics_daily WHERE metric_key = 'events_by_path' AND dimensions = '{{"path":"/pricing"}}'""")
def _(spark, sf):
    return reads.total(reads.with_dimensions(reads.list_metrics(stored(spark, sf), ["events_by_path"]), {"path": "/pricing"}))


SPARK_KEYS = ["page_views", "unique_visitors"]
SERIES_SQL = f"series AS (SELECT metric_key, day, sum(metric_value) AS v FROM metrics_daily WHERE metric_key IN ('page_views', 'unique_visitors') GROUP BY ALL)"


def _named_series(spark, sf) -> DataFrame:
    return reads.list_metrics(stored(spark, sf), SPARK_KEYS).groupBy("metric_key", "day").agg(F.sum("metric_value").alias("metric_value"))


@query("sparkline_points", f"""WITH {ROLLUP_SQL}, {SERIES_SQL}, s AS (SELECT *, least(min(v) OVER w, 0) AS lo, greatest(max(v) OVER w, 1) AS hi, row_number() OVER (PARTITION BY metric_key ORDER BY day) - 1 AS i, count(*) OVER w - 1 AS n FROM series WINDOW w AS (PARTITION BY metric_key))
SELECT metric_key, day::VARCHAR AS day, round(CASE WHEN n = 0 THEN 0 ELSE i::DOUBLE / n * 100 END, 2)::DOUBLE AS x, round(82 - (v - lo) / greatest(hi - lo, 1) * 64, 2)::DOUBLE AS y FROM s""")
def _(spark, sf):
    return text_day(reads.sparkline(_named_series(spark, sf), ["metric_key"]))


@query("trend_points", f"""WITH {ROLLUP_SQL}, {SERIES_SQL} SELECT metric_key, day::VARCHAR AS day, round(92 - v / greatest(max(v) OVER (PARTITION BY metric_key), 1) * 78, 4)::DOUBLE AS y_own, round(90 - v / greatest(max(v) OVER (), 1) * 76, 4)::DOUBLE AS y_shared FROM series""")
def _(spark, sf):
    return text_day(reads.trend_both(_named_series(spark, sf)))


# Users


def _user_slice(name: str, key: str) -> None:
    @query(name, f"WITH {USER_METRICS_SQL} SELECT day::VARCHAR AS day, dimensions, metric_value FROM user_metrics WHERE metric_key = '{key}'")
    def _(spark, sf):
        return text_day(rollup.user_metrics(tables.users(spark, sf)).where(F.col("metric_key") == key).select("day", "dimensions", "metric_value"))


for _name, _key in (("signups_daily", "signups"), ("signups_cumulative", "users_total"), ("confirmed_cumulative", "confirmed_users"), ("signups_by_provider", "signups_by_provider")):
    _user_slice(_name, _key)


@query("users_json_explode", """SELECT c_custkey // 50 AS payload_id, 'u' || c_custkey AS user_id, CASE WHEN c_custkey % 7 = 0 THEN '2024-01-30' ELSE '2024-01-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') END AS day,
CASE c_custkey % 4 WHEN 0 THEN 'google' WHEN 1 THEN 'github' ELSE 'email' END AS provider, c_custkey % 3 = 0 AS confirmed FROM customer""")
def _(spark, sf):
    """JSON arrays of users, 50 a payload, exploded again: dates that don't parse fall on the anchor day, providers cascade."""
    c = tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    k = F.col("k")
    created = F.when(k % 7 == 0, "not a date").otherwise(F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T08:00:00Z")))
    user = F.struct(F.concat(F.lit("u"), k).alias("id"), created.alias("created_at"), F.when(k % 3 == 0, created).alias("confirmed_at"), F.when(k % 4 == 0, "google").when(k % 4 == 2, "").alias("provider"), F.when(k % 4 == 1, F.struct(F.lit("github").alias("provider"))).alias("app_metadata"))
    bodies = c.groupBy(F.floor(k / 50).alias("payload_id")).agg(F.to_json(F.collect_list(user)).alias("body"))
    return text_day(payloads.exploded_users(bodies, AS_OF))


PROFILE = ["record", "new", "profile"]


@query("profile_record_extract", """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE 'p' || c_custkey END AS record_id FROM customer""")
def _(spark, sf):
    """The user record of webhook bodies, under any of its keys, at the top or under data; a body without one has none."""
    k = F.col("c_custkey")
    record = F.concat(F.lit('{"id":"p'), k, F.lit('"}'))
    key = F.element_at(F.array(*map(F.lit, PROFILE)), (k % 3 + 1).cast("int"))
    top = F.concat(F.lit('{"'), key, F.lit('":'), record, F.lit("}"))
    body = F.when(k % 5 == 4, '{"record":"text"}').when(k % 2 == 0, top).otherwise(F.concat(F.lit('{"data":'), top, F.lit("}")))
    found = payloads.profile_record(F.col("body"))
    return tables.read(spark, sf, "customer").select(k.alias("user_id"), body.alias("body")).select("user_id", F.get_json_object(found, "$.id").alias("record_id"))


@query("provider_cascade", "SELECT c_custkey % 6 AS kind, CASE c_custkey % 6 WHEN 0 THEN 'google' WHEN 1 THEN 'github' WHEN 2 THEN 'gitlab' WHEN 3 THEN 'email' WHEN 4 THEN 'apple' ELSE 'email' END AS provider, count(*) AS n FROM customer GROUP BY ALL")
def _(spark, sf):
    """provider, else app metadata, else raw metadata, else email."""
    k = F.col("c_custkey") % 6
    meta = lambda when, v: F.when(when, F.struct(F.lit(v).alias("provider")))
    user = F.struct(F.when(k == 0, "google").when(k == 4, "apple").when(k == 3, "").alias("provider"), meta(k.isin(1, 4), "github").alias("app_metadata"), meta(k.isin(2, 1), "gitlab").alias("raw_app_meta_data"))
    return tables.read(spark, sf, "customer").select(k.alias("kind"), user.alias("u")).groupBy("kind", payloads.provider_of(F.col("u")).alias("provider")).agg(F.count("*").alias("n"))


# Sinks

BATCH = "day >= '2024-01-20'"
UPSERT_SQL = f"""{ROLLUP_SQL}, target AS (SELECT day, source_id, metric_key, dimensions, metric_value FROM metrics_daily WHERE day < '2024-01-25'),
batch AS (SELECT day, source_id, metric_key, dimensions, metric_value + 1 AS metric_value FROM metrics_daily WHERE {BATCH}),
merged AS (SELECT * FROM batch UNION ALL SELECT * FROM target t WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.day = t.day AND b.source_id = t.source_id AND b.metric_key = t.metric_key AND b.dimensions = t.dimensions))"""


def _upsert_inputs(spark, sf):
    m = metrics(spark, sf)
    batch = m.where(BATCH).withColumn("metric_value", F.col("metric_value") + 1).withColumn("seq", F.lit(1))
    return m.where("day < '2024-01-25'"), batch


@query("metric_upsert", f"WITH {UPSERT_SQL} SELECT day::VARCHAR AS day, source_id, metric_key, dimensions, metric_value FROM merged")
def _(spark, sf):
    target, batch = _upsert_inputs(spark, sf)
    old = batch.withColumn("metric_value", F.lit(-1.0)).withColumn("seq", F.lit(0))  # an earlier row of the batch, which the later one replaces
    return text_day(store.upsert(target, old.unionByName(batch), store.METRIC_KEY, "seq").drop("dimensions_hash"))


@query("metric_upsert_replay", f"WITH {UPSERT_SQL} SELECT day::VARCHAR AS day, source_id, metric_key, dimensions, metric_value FROM merged")
def _(spark, sf):
    target, batch = _upsert_inputs(spark, sf)
    once = store.upsert(target, batch, store.METRIC_KEY, "seq")
    return text_day(store.upsert(once, batch, store.METRIC_KEY, "seq").drop("dimensions_hash"))


@query("metric_increment", f"""WITH {UPSERT_SQL} SELECT day::VARCHAR AS day, source_id, metric_key, dimensions, sum(metric_value)::DOUBLE AS metric_value FROM (SELECT * FROM target UNION ALL SELECT * FROM batch) GROUP BY ALL""")
def _(spark, sf):
    target, batch = _upsert_inputs(spark, sf)
    return text_day(store.increment(target, batch.drop("seq")).drop("dimensions_hash"))


RAW_SQL = """p AS (SELECT doc_id AS seq, lang AS source_id, sha256(text) AS payload_hash FROM documents), b AS (SELECT *, min(seq) OVER (PARTITION BY source_id, payload_hash) AS f FROM p WHERE seq % 10 <> 0),
r AS (SELECT seq, source_id, payload_hash, seq = f AND NOT EXISTS (SELECT 1 FROM p x WHERE x.seq % 10 = 0 AND x.source_id = b.source_id AND x.payload_hash = b.payload_hash) AS is_new FROM b)"""


def _landed(spark, sf):
    """Every tenth payload has landed before; the others come as one batch."""
    p = tables.raw_payloads(spark, sf)
    return store.land(p.where("seq % 10 = 0"), p.where("seq % 10 <> 0"))


@query("raw_dedup", f"WITH {RAW_SQL} SELECT seq, source_id, payload_hash, is_new FROM r")
def _(spark, sf):
    return _landed(spark, sf)


@query("raw_dedup_counts", f"WITH {RAW_SQL} SELECT source_id, count(*) FILTER (WHERE is_new) AS inserted, count(*) FILTER (WHERE NOT is_new) AS duplicates FROM r GROUP BY 1")
def _(spark, sf):
    return _landed(spark, sf).groupBy("source_id").agg(F.count_if("is_new").alias("inserted"), F.count_if(~F.col("is_new")).alias("duplicates"))


CHANGES = [("src_photo", "last_error", None), ("src_photo", "status", "healthy"), ("src_video", "display_name", "Clips")]


@query("partial_update", f"""WITH {SOURCES_SQL} SELECT id, CASE WHEN id = 'src_video' THEN 'Clips' ELSE display_name END AS display_name, CASE WHEN id = 'src_photo' THEN 'healthy' ELSE status END AS status, CASE WHEN id = 'src_photo' THEN NULL ELSE last_error END AS last_error, frequency_minutes FROM sources""")
def _(spark, sf):
    rows = tables.sources(spark).select("id", "display_name", "status", "last_error", "frequency_minutes")
    return store.patch(rows, tables.rows(spark, CHANGES, "id string, column string, value string"), "id")


@query("delete_cascade", f"""WITH {RUNS_SQL}, {LOCKS_SQL} SELECT 'run' AS kind, id AS row_id, CASE WHEN source_id = 'src_tracker' THEN NULL ELSE source_id END AS source_id FROM sync_runs UNION ALL SELECT 'lock', owner, source_id FROM locks WHERE source_id <> 'src_tracker'""")
def _(spark, sf):
    """Facts lose a deleted source, its locks go with it."""
    gone = tables.sources(spark).where("id = 'src_tracker'")
    runs = store.delete_source(tables.sync_runs(spark), gone, False).select(F.lit("run").alias("kind"), F.col("id").alias("row_id"), "source_id")
    locks = store.delete_source(tables.rows(spark, tables.LOCKS, tables.LOCKS_SCHEMA), gone, True).select(F.lit("lock").alias("kind"), F.col("owner").alias("row_id"), "source_id")
    return runs.unionByName(locks)


# Ingestion


def _incoming(spark, sf) -> DataFrame:
    """Events as they come in, some of them broken, by event_id."""
    k = F.col("event_id") % 50
    pad = lambda n: F.repeat(F.lit("x"), F.lit(n))
    name = F.when(k == 1, pad(90)).when(k == 2, "has space").otherwise(F.col("event_name"))
    props = F.when(k == 5, F.concat(F.lit('{"a":"'), pad(9000), F.lit('"}'))).when(k == 6, F.repeat(F.lit("é"), F.lit(4096))).when(k == 7, F.concat(F.repeat(F.lit("é"), F.lit(4096)), F.lit("x"))).otherwise("{}")
    path = F.when(k == 3, "").otherwise(F.col("path"))
    url = F.when(k == 4, "not a url").otherwise(F.concat(F.lit("https://site.example"), F.col("path")))
    return tables.web_events(spark, sf).select("event_id", "anonymous_id", "session_id", name.alias("event_name"), path.alias("path"), url.alias("url"), "referrer", props.alias("properties"))


PROBLEM = "CASE event_id % 50 WHEN 1 THEN 'event_name' WHEN 2 THEN 'event_name' WHEN 3 THEN 'path' WHEN 4 THEN 'url' WHEN 5 THEN 'properties' WHEN 7 THEN 'properties' ELSE '' END"


@query("event_validation", f"SELECT event_id, {PROBLEM} AS problems, {PROBLEM} = '' AS valid FROM events")
def _(spark, sf):
    return validate.validated(_incoming(spark, sf)).select("event_id", "problems", "valid")


@query("event_rejects", f"SELECT {PROBLEM} AS problems, count(*) AS n FROM events WHERE {PROBLEM} <> '' GROUP BY 1")
def _(spark, sf):
    return validate.validated(_incoming(spark, sf)).where(~F.col("valid")).groupBy("problems").agg(F.count("*").alias("n"))


@query("property_size_check", "SELECT event_id, CASE event_id % 50 WHEN 5 THEN 9008 WHEN 6 THEN 8192 WHEN 7 THEN 8193 ELSE 2 END AS n_bytes, event_id % 50 NOT IN (5, 7) AS fits FROM events")
def _(spark, sf):
    n = F.octet_length("properties")
    return _incoming(spark, sf).select("event_id", n.alias("n_bytes"), (n <= validate.MAX_PROPERTY_BYTES).alias("fits"))


ORIGINS = ["https://site.example", "https://evil.example", None]


@query("origin_allowlist", f"""WITH {WEB_EVENTS}, {SOURCES_SQL}, o AS (SELECT source_id, CASE event_id % 3 WHEN 0 THEN 'https://site.example' WHEN 1 THEN 'https://evil.example' END AS origin FROM web_events)
SELECT o.source_id, origin, origin IS NULL OR origins IS NULL OR origins = '' OR list_contains(string_split(origins, ','), origin) AS allowed, count(*) AS n FROM o JOIN sources s ON s.id = o.source_id GROUP BY ALL""")
def _(spark, sf):
    origin = F.element_at(F.array(*[F.lit(o) for o in ORIGINS]), (F.col("event_id") % 3 + 1).cast("int"))
    e = tables.web_events(spark, sf).select("source_id", origin.alias("origin"))
    s = tables.sources(spark).select(F.col("id").alias("source_id"), "origins")
    return e.join(F.broadcast(s), "source_id").groupBy("source_id", "origin", validate.origin_allowed(F.col("origin"), F.col("origins")).alias("allowed")).agg(F.count("*").alias("n"))


@query("source_resolution", f"""WITH {SOURCES_SQL}, e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'src_drain' WHEN 1 THEN 'src_unknown' END AS sid, CASE WHEN event_id % 4 = 2 THEN 'key_tracker_0002' END AS tk FROM events)
SELECT event_id % 4 AS kind, CASE event_id % 4 WHEN 0 THEN 'src_drain' WHEN 1 THEN 'src_unknown' WHEN 2 THEN 'src_tracker' END AS resolved_id, coalesce(a.type_key, b.type_key) AS resolved_type, count(*) AS n
FROM e LEFT JOIN sources a ON a.id = sid LEFT JOIN sources b ON sid IS NULL AND b.tracking_key = tk GROUP BY ALL""")
def _(spark, sf):
    k = F.col("event_id") % 4
    e = tables.read(spark, sf, "events").select(k.alias("kind"), F.when(k == 0, "src_drain").when(k == 1, "src_unknown").alias("source_id"), F.when(k == 2, "key_tracker_0002").alias("tracking_key"))
    return validate.resolve_source(e, tables.sources(spark)).groupBy("kind", "resolved_id", "resolved_type").agg(F.count("*").alias("n"))


@query("identity_exists", f"""WITH {WEB_EVENTS}, p AS (SELECT event_id AS probe_id, source_id, CASE WHEN event_id % 2 = 0 THEN day ELSE day + 40 END AS day, anonymous_id, CASE WHEN event_id % 3 = 0 THEN 'none' ELSE session_id END AS session_id FROM web_events)
SELECT probe_id, EXISTS (SELECT 1 FROM web_events w WHERE w.source_id = p.source_id AND w.day = p.day AND w.anonymous_id = p.anonymous_id) OR EXISTS (SELECT 1 FROM web_events w WHERE w.source_id = p.source_id AND w.day = p.day AND w.session_id = p.session_id) AS seen FROM p""")
def _(spark, sf):
    e = tables.web_events(spark, sf)
    k = F.col("event_id")
    probes = e.select(k.alias("probe_id"), "source_id", F.when(k % 2 == 0, F.col("day")).otherwise(F.date_add("day", 40)).alias("day"), "anonymous_id", F.when(k % 3 == 0, "none").otherwise(F.col("session_id")).alias("session_id"))
    return validate.identity_seen(probes, e)


URLS = ["https://xxxxx.supabase.co", "https://example.com", "https://your-store.myshopify.com", "https://www.tiktok.com/@account", "https://www.instagram.com/account", "https://vercel.com/team/project", "https://admin.shopify.com/store/abc/orders", "https://www.instagram.com/reel/1", "report.CSV", "https://site.example/a?b", "not a url", "ftp://files.example/x", "https://vercel.com/team", "HTTP://Example.org:8080/x", ""]
URL_TRUTH = [
    ("supabase", 0.98, "https://xxxxx.supabase.co"), ("website", 0.6, "https://example.com"), ("shopify", 0.98, "https://your-store.myshopify.com"), ("tiktok", 0.96, "https://www.tiktok.com/@account"),
    ("instagram", 0.94, "https://www.instagram.com/account"), ("vercel_project", 0.94, "https://vercel.com/team/project"), ("shopify", 0.98, "https://admin.shopify.com/store/abc"), ("website", 0.6, "https://www.instagram.com"),
    ("custom_csv", 0.72, "report.CSV"), ("website", 0.99, "https://site.example"), (None, None, None), (None, None, None), ("website", 0.6, "https://vercel.com"), ("website", 0.6, "http://example.org:8080"), (None, None, None),
]
URL_ROWS = [(u, *t) for u, t in zip(URLS, URL_TRUTH, strict=True)]


@query("url_classifier", f"""WITH {tables.values('truth', URL_ROWS, 'url string, type string, confidence double, normalized string')}
SELECT * FROM truth UNION ALL SELECT url, 'website', 0.6, regexp_extract(url, '^https?://[^/?#]*') FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL)""")
def _(spark, sf):
    urls = tables.rows(spark, [(u,) for u in URLS], "url string").union(tables.read(spark, sf, "pages").select("url").where("url IS NOT NULL").distinct())
    return urls.select("url", web.classify(F.col("url")).alias("c")).select("url", "c.*")


@query("url_normalize", """SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin, len(list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) AS n_segments FROM pages WHERE url IS NOT NULL""")
def _(spark, sf):
    u = F.col("url")
    return tables.read(spark, sf, "pages").where(u.isNotNull()).select("page_id", web.host(u).alias("host"), web.origin(u).alias("origin"), F.size(web.segments(u)).cast("long").alias("n_segments"))


def _deliveries(spark, sf, whole: bool = False) -> DataFrame:
    """Drain deliveries of ten events each: a third as JSON arrays, a third as lines, a third as single objects.

    A single object is the first of its ten events, or if `whole`, each event is a delivery of its own (keys under 0).
    """
    e = tables.web_events(spark, sf).where(F.col("source_id") == "src_drain").withColumn("delivery_id", F.floor(F.col("event_id") / 10))
    if whole:
        e = e.withColumn("delivery_id", F.when(F.col("delivery_id") % 3 == 2, -1 - F.col("event_id")).otherwise(F.col("delivery_id")))
    name = F.when(F.col("event_name") == "page_view", "pageview").otherwise("custom")
    event = F.struct(
        name.alias("eventType"), F.when(F.col("event_name") != "page_view", F.col("event_name")).alias("eventName"), F.concat(F.lit('{"id":"'), F.col("event_id"), F.lit('"}')).alias("eventData"),
        F.lit(1704067200000).alias("timestamp"), F.col("session_id").alias("sessionId"), F.col("anonymous_id").alias("deviceId"), F.lit("https://site.example/").alias("origin"), "path", F.lit("Browser").alias("clientName"), F.lit("9").alias("clientVersion"),
    )
    json = F.to_json("e")
    rows = e.select("delivery_id", F.struct("event_id", event.alias("e")).alias("s")).groupBy("delivery_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    lines = F.transform("s", lambda x: F.to_json(x["e"]))
    k = F.when(F.col("delivery_id") < 0, 2).otherwise(F.col("delivery_id") % 3)
    body = F.when(k == 0, F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]"))).when(k == 1, F.array_join(lines, "\n")).otherwise(lines[0])
    return rows.select("delivery_id", body.alias("body"))


DRAIN_SQL = f"""{WEB_EVENTS}, d AS (SELECT *, event_id // 10 AS delivery_id FROM web_events WHERE source_id = 'src_drain'), n AS (SELECT *, row_number() OVER (PARTITION BY delivery_id ORDER BY event_id) - 1 AS position FROM d), k AS (SELECT * FROM n WHERE delivery_id % 3 < 2 OR position = 0)"""


@query("drain_body_parse", f"WITH {DRAIN_SQL} SELECT delivery_id, count(*) AS n FROM k GROUP BY 1")
def _(spark, sf):
    return payloads.parse_bodies(_deliveries(spark, sf)).groupBy("delivery_id").agg(F.count("*").alias("n"))


@query("drain_mapping", f"""WITH {DRAIN_SQL} SELECT delivery_id, position::INTEGER AS position, event_name, anonymous_id, session_id, path, 'https://site.example' || path AS url, 'Browser 9' AS user_agent, '{{"id":"' || event_id || '","vendor":"{{\\"client_name\\":\\"Browser\\",\\"client_version\\":\\"9\\"}}"}}' AS properties,
'2024-01-01T00:00:00' AS occurred_at, CASE WHEN event_name = 'page_view' THEN 'pageview' ELSE 'custom' END || ':1704067200000:' || anonymous_id || ':' || session_id AS external_id FROM k""")
def _(spark, sf):
    return payloads.drain_events(payloads.parse_bodies(_deliveries(spark, sf)), F.lit("https://site.example"))


# The same over every drain event.
DRAIN_ALL_SQL = f"""{WEB_EVENTS}, d AS (SELECT *, CASE WHEN event_id // 10 % 3 = 2 THEN -1 - event_id ELSE event_id // 10 END AS delivery_id FROM web_events WHERE source_id = 'src_drain'), k AS (SELECT *, row_number() OVER (PARTITION BY delivery_id ORDER BY event_id) - 1 AS position FROM d)"""


@query("drain_body_parse_all", _SQL["drain_body_parse"].replace(DRAIN_SQL, DRAIN_ALL_SQL))
def _(spark, sf):
    return payloads.parse_bodies(_deliveries(spark, sf, True)).groupBy("delivery_id").agg(F.count("*").alias("n"))


@query("drain_mapping_all", _SQL["drain_mapping"].replace(DRAIN_SQL, DRAIN_ALL_SQL))
def _(spark, sf):
    return payloads.drain_events(payloads.parse_bodies(_deliveries(spark, sf, True)), F.lit("https://site.example"))


@query("drain_retries", _SQL["drain_mapping_all"])
def _(spark, sf):
    """Every delivery is sent twice; its events are mapped once."""
    d = _deliveries(spark, sf, True)
    return payloads.drain_events(payloads.parse_once(d.union(d)), F.lit("https://site.example")).drop("event_key")


# Sources' state


@query("due_sources", f"""WITH {SOURCES_SQL} SELECT id, coalesce(next_sync_at, created_at) AS due_at FROM sources WHERE status <> 'disabled' AND sync_mode NOT IN ('manual', 'webhook') AND (next_sync_at IS NULL OR next_sync_at <= '{NOW}')""")
def _(spark, sf):
    return sync.due(tables.sources(spark), NOW).select("id", F.coalesce("next_sync_at", "created_at").alias("due_at"))


RESULTS = [("src_drain", "webhook", True, None), ("src_tracker", "manual", True, None), ("src_video", "cron", True, None), ("src_photo", "cron", False, None), ("src_users", "cron", False, "Timeout")]


@query("sync_state_transition", f"""WITH {SOURCES_SQL}, {tables.values('runs', RESULTS, 'source_id string, trigger string, ok boolean, error string')}
SELECT id, CASE WHEN NOT ok THEN 'error' WHEN status = 'demo' THEN 'demo' ELSE 'healthy' END AS status, strftime(TIMESTAMP '{NOW}' + to_minutes(frequency_minutes), '%Y-%m-%dT%H:%M:%S') AS next_sync_at, CASE WHEN ok THEN '{NOW}' ELSE last_success_at END AS last_success_at,
CASE WHEN trigger = 'webhook' THEN '{NOW}' ELSE last_webhook_at END AS last_webhook_at, CASE WHEN NOT ok THEN coalesce(error, 'Sync failed.') END AS last_error FROM sources JOIN runs ON id = source_id""")
def _(spark, sf):
    return sync.after_run(tables.sources(spark), tables.rows(spark, RESULTS, "source_id string, trigger string, ok boolean, error string"), NOW)


@query("lease_acquire", f"""WITH {LOCKS_SQL}, {REQUESTS_SQL}, w AS (SELECT r.*, seq = min(seq) OVER (PARTITION BY source_id) AND NOT EXISTS (SELECT 1 FROM locks l WHERE l.source_id = r.source_id AND l.expires_at > '{NOW}') AS acquired FROM requests r)
SELECT seq, source_id, owner, acquired, CASE WHEN acquired THEN '2024-01-30T12:05:00' END AS expires_at FROM w""")
def _(spark, sf):
    return sync.acquire(tables.rows(spark, tables.LOCKS, tables.LOCKS_SCHEMA), tables.rows(spark, tables.REQUESTS, tables.REQUESTS_SCHEMA), NOW)


@query("primary_source", f"""WITH {SOURCES_SQL} SELECT id, type_key, row_number() OVER (ORDER BY (status = 'disabled')::INT, CASE type_key WHEN 'website' THEN 2 ELSE 1 END, display_name) = 1 AND status <> 'disabled' AS is_primary FROM sources WHERE type_key IN ('website', 'vercel_web_analytics_drain')""")
def _(spark, sf):
    return sync.web_sources(tables.sources(spark)).select("id", "type_key", "is_primary")


@query("mode_label", f"""WITH {SOURCES_SQL} SELECT id, CASE WHEN type_key = 'vercel_web_analytics_drain' THEN 'Drain' WHEN status = 'demo' THEN 'Demo' ELSE 'Tracker' END AS label FROM sources UNION ALL SELECT 'none', 'Demo'""")
def _(spark, sf):
    none = tables.rows(spark, [("none", None, None)], "id string, type_key string, status string")
    rows = tables.sources(spark).select("id", "type_key", "status").unionByName(none)
    return rows.select("id", sync.mode_label(F.col("type_key"), F.col("status")).alias("label"))


STATES = [(m, s, h, c) for m in ("website", "supabase", "tiktok") for s in (None, "healthy", "needs_credentials", "error", "disabled", "demo", "warning") for h in (False, True) for c in (False, True)]


@query("setup_state", f"""WITH {tables.values('states', STATES, 'module string, status string, has_secondary boolean, scaffold boolean')}
SELECT *, CASE WHEN status IS NULL THEN CASE WHEN module IN ('website', 'supabase') THEN 'Needs setup' ELSE 'Future' END WHEN status = 'healthy' THEN CASE WHEN module = 'website' AND has_secondary THEN 'Primary mode active' ELSE 'Connected' END
WHEN status = 'needs_credentials' THEN 'Needs credentials' WHEN status = 'error' THEN 'Sync error' WHEN status = 'disabled' THEN 'Disabled' WHEN scaffold THEN 'Scaffold demo' ELSE 'Demo mode' END AS label,
CASE WHEN status IS NULL THEN CASE WHEN module IN ('website', 'supabase') THEN 'warning' ELSE 'demo' END WHEN status = 'healthy' THEN 'ok' WHEN status = 'needs_credentials' THEN 'warning' WHEN status IN ('error', 'disabled') THEN 'error' ELSE 'demo' END AS severity FROM states""")
def _(spark, sf):
    rows = tables.rows(spark, STATES, "module string, status string, has_secondary boolean, scaffold boolean")
    return rows.withColumn("s", sync.setup_state(F.col("module"), F.col("status"), F.col("has_secondary"), F.col("scaffold"))).select("*", "s.*").drop("s")


TONES = [("healthy", "green"), ("success", "green"), ("connected", "green"), ("demo", "cyan"), ("running", "cyan"), ("needs_credentials", "amber"), ("warning", "amber"), ("queued", "amber"), ("skipped", "amber"), ("error", "rose"), ("disabled", "rose"), ("other", "slate")]


@query("status_tone", f"WITH {tables.values('tones', TONES, 'status string, tone string')}, {RUNS_SQL} SELECT t.status, t.tone, count(r.id) AS n_runs FROM tones t LEFT JOIN sync_runs r ON r.status = t.status GROUP BY ALL")
def _(spark, sf):
    all_ = tables.rows(spark, [(s,) for s, _ in TONES], "status string")
    n = tables.sync_runs(spark).groupBy("status").agg(F.count("*").alias("n"))
    return all_.join(n, "status", "left").select("status", web.status_tone(F.col("status")).alias("tone"), F.coalesce("n", F.lit(0)).alias("n_runs"))


@query("platform_modules_7d", f"""WITH {ALL_METRICS_SQL}, {SOURCES_SQL}, m(position, module, metric_key) AS (VALUES {', '.join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(sync.MODULES))}),
web AS (SELECT * FROM sources WHERE type_key IN ('website', 'vercel_web_analytics_drain')), prim AS (SELECT id FROM web WHERE status <> 'disabled' ORDER BY CASE type_key WHEN 'website' THEN 2 ELSE 1 END, display_name LIMIT 1),
chosen AS (SELECT 'website' AS module, * FROM web WHERE id IN (SELECT id FROM prim) UNION ALL SELECT type_key, * FROM sources WHERE type_key NOT IN ('website', 'vercel_web_analytics_drain') QUALIFY row_number() OVER (PARTITION BY type_key ORDER BY display_name) = 1),
v AS (SELECT source_id, metric_key, coalesce(sum(metric_value) FILTER (WHERE day >= '2024-01-24'), 0) AS c, coalesce(sum(metric_value) FILTER (WHERE day < '2024-01-24'), 0) AS p FROM all_metrics WHERE day BETWEEN '2024-01-17' AND '2024-01-30' GROUP BY ALL),
x AS (SELECT m.position, m.module, s.id AS source_id, coalesce(s.status, CASE WHEN m.module IN ('shopify', 'custom_api', 'custom_csv') THEN 'disabled' ELSE 'demo' END) AS status, m.metric_key, coalesce(v.c, 0)::DOUBLE AS current_value, coalesce(v.p, 0)::DOUBLE AS previous_value, s.status AS st, s.scaffold, coalesce(s.last_success_at, s.last_webhook_at) AS last_sync_at, s.last_error
FROM m LEFT JOIN chosen s ON s.module = m.module LEFT JOIN v ON v.source_id = s.id AND v.metric_key = m.metric_key)
SELECT position, module, source_id, status, metric_key, current_value, previous_value, {DELTA_CASE},
CASE WHEN st IS NULL THEN 'Future' WHEN st = 'healthy' THEN CASE WHEN module = 'website' THEN 'Primary mode active' ELSE 'Connected' END WHEN st = 'error' THEN 'Sync error' WHEN st = 'disabled' THEN 'Disabled' WHEN scaffold THEN 'Scaffold demo' ELSE 'Demo mode' END AS setup_label,
CASE WHEN st IS NULL THEN 'demo' WHEN st = 'healthy' THEN 'ok' WHEN st IN ('error', 'disabled') THEN 'error' ELSE 'demo' END AS setup_severity, last_sync_at, last_error FROM x""")
def _(spark, sf):
    return sync.modules(tables.sources(spark), _by_source(spark, sf, "7d"))


def _by_source(spark, sf, key: str) -> DataFrame:
    start, end = reads.date_range(key, AS_OF)
    rows = reads.list_metrics(stored(spark, sf), None, None, reads.previous_range(start, end)[0], end)
    now = F.col("day") >= F.lit(start)
    return rows.groupBy("source_id", "metric_key").agg(F.sum(F.when(now, F.col("metric_value"))).alias("current_value"), F.sum(F.when(~now, F.col("metric_value"))).alias("previous_value"))


@query("system_health", f"""WITH {SOURCES_SQL}, {RUNS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE status IN ('demo', 'healthy')) AS healthy, count(*) FILTER (WHERE status IN ('needs_credentials', 'warning')) AS warning, count(*) FILTER (WHERE status = 'error') AS error, (SELECT count(*) FROM sync_runs WHERE status = 'running') AS active_runs FROM sources""")
def _(spark, sf):
    s = F.col("status")
    one = tables.sources(spark).agg(F.count("*").alias("total"), F.count_if(s.isin("demo", "healthy")).alias("healthy"), F.count_if(s.isin("needs_credentials", "warning")).alias("warning"), F.count_if(s == "error").alias("error"))
    return one.crossJoin(F.broadcast(tables.sync_runs(spark).agg(F.count_if(s == "running").alias("active_runs"))))


@query("recent_runs", f"WITH {RUNS_SQL} SELECT id, source_id, status, created_at FROM sync_runs WHERE status = 'success' ORDER BY created_at DESC, id DESC LIMIT 5")
def _(spark, sf):
    return tables.sync_runs(spark).where("status = 'success'").orderBy(F.desc("created_at"), F.desc("id")).limit(5).select("id", "source_id", "status", "created_at")


@query("global_health", f"""WITH {ALL_METRICS_SQL} SELECT 5::BIGINT AS active_modules_and_disabled, 4::BIGINT AS connected, 1::BIGINT AS errors, '2024-01-30T10:00:00' AS last_sync_at, 'Setup and live' AS mode, (SELECT sum(metric_value) FROM all_metrics WHERE metric_key IN ('page_views', 'custom_events') AND day BETWEEN '2024-01-01' AND '2024-01-30')::DOUBLE AS tracked_events""")
def _(spark, sf):
    """Health over the modules of 30 days, and the events tracked by all sources."""
    mods = sync.modules(tables.sources(spark), _by_source(spark, sf, "30d"))
    s, has = F.col("status"), F.col("source_id").isNotNull()
    live = has & (s != "disabled")
    one = mods.agg(F.count_if(has).alias("active_modules_and_disabled"), F.count_if(live).alias("connected"), F.count_if((s == "error") | F.col("last_error").isNotNull()).alias("errors"), F.max(F.when(live, F.col("last_sync_at"))).alias("last_sync_at"), F.when(F.max(s.isin("demo", "needs_credentials")), "Setup and live").otherwise("Live").alias("mode"))
    start, end = reads.date_range("30d", AS_OF)
    tracked = reads.total(reads.list_metrics(stored(spark, sf), ["page_views", "custom_events"], None, start, end)).withColumnRenamed("metric_value", "tracked_events")
    return one.crossJoin(F.broadcast(tracked))


# Functions


@query("mask_secret", f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '{web.BULLETS}' ELSE left(c_name, 4) || '{web.BULLETS}' || right(c_name, 4) END AS hint FROM customer")
def _(spark, sf):
    value = F.when(F.col("c_custkey") % 3 == 0, F.left("c_name", F.lit(8))).otherwise(F.col("c_name"))
    return tables.read(spark, sf, "customer").select("c_custkey", web.mask_secret(value).alias("hint"))


@query("ip_hash", "SELECT event_id, CASE WHEN user_id % 5 <> 0 THEN sha256('salt:10.0.0.' || user_id) END AS ip_hash FROM events")
def _(spark, sf):
    ip = F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("10.0.0."), F.col("user_id")))
    return tables.read(spark, sf, "events").select("event_id", web.ip_hash(ip, "salt").alias("ip_hash"))


@query("hmac_verify", "SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, true), (5, true)) t(id, valid)")
def _(spark, sf):
    """Good, wrong and missing signatures of bodies."""
    import hashlib
    import hmac

    sign = lambda b: hmac.new(b"secret", b.encode(), hashlib.sha1).hexdigest()
    data = [(1, "body", sign("body")), (2, "body", sign("other")), (3, "body", None), (4, "", sign("")), (5, None, sign(""))]
    rows = tables.rows(spark, data, "id int, body string, signature string")
    return rows.select("id", web.verify_signature(F.col("body"), F.col("signature"), "secret").alias("valid"))


@query("credential_roundtrip", "SELECT c_custkey, c_name AS value FROM customer")
def _(spark, sf):
    key = "0123456789abcdef0123456789abcdef"
    sealed = tables.read(spark, sf, "customer").select("c_custkey", web.seal(F.col("c_name"), key).alias("sealed"))
    return sealed.select("c_custkey", web.unseal(F.col("sealed"), key).alias("value"))


# Commerce and content

MONEY = "decimal(18,4)"


@query("commerce_daily", """SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, count(DISTINCT o_orderkey) AS orders, sum(CAST(l_extendedprice AS DECIMAL(18,4)))::DOUBLE AS gross_sales, sum(CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(8,4))) AS DECIMAL(18,4)))::DOUBLE AS net_payment,
sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,4)) ELSE 0 END)::DOUBLE AS refunds FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def _(spark, sf):
    """Orders, gross and net sales and refunds a day; lines are summed by order before the join."""
    price = F.col("l_extendedprice").cast(MONEY)
    lines = tables.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(price).alias("gross"), F.sum((price * (1 - F.col("l_discount").cast("decimal(8,4)"))).cast(MONEY)).alias("net"), F.sum(F.when(F.col("l_returnflag") == "R", price).otherwise(0)).alias("back"))
    o = tables.read(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    rows = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    out = rows.groupBy("day").agg(F.count("*").alias("orders"), F.sum("gross").cast("double").alias("gross_sales"), F.sum("net").cast("double").alias("net_payment"), F.sum("back").cast("double").alias("refunds"))
    return text_day(out)


@query("top_products", "SELECT p_partkey, p_name, sum(l_quantity)::DOUBLE AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL ORDER BY quantity DESC, p_partkey LIMIT 10")
def _(spark, sf):
    """The ten products sold most; only they are joined to their names."""
    sold = tables.read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity")).orderBy(F.desc("quantity"), "l_partkey").limit(10)
    part = tables.read(spark, sf, "part").select("p_partkey", "p_name")
    return part.join(F.broadcast(sold), F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_name", "quantity")


@query("content_recent", "SELECT doc_id, source AS content_type, left(text, 40) AS title FROM documents ORDER BY doc_id DESC LIMIT 50")
def _(spark, sf):
    d = tables.read(spark, sf, "documents").select("doc_id", F.col("source").alias("content_type"), F.left("text", F.lit(40)).alias("title"))
    return d.orderBy(F.desc("doc_id")).limit(50)


@query("content_metrics_daily", "SELECT '2024-01-' || lpad((doc_id % 30 + 1)::VARCHAR, 2, '0') AS day, lang AS content_item, 'characters' AS metric_key, sum(n_chars)::DOUBLE AS metric_value FROM documents GROUP BY ALL")
def _(spark, sf):
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 30 + 1).cast("string"), 2, "0"))
    d = tables.read(spark, sf, "documents").select(day.alias("day"), F.col("lang").alias("content_item"), "n_chars")
    return d.groupBy("day", "content_item", F.lit("characters").alias("metric_key")).agg(F.sum("n_chars").cast("double").alias("metric_value"))


@query("stream_rollup_parity", f"WITH {ROLLUP_SQL} SELECT day::VARCHAR AS day, source_id, metric_key, dimensions, dimensions_hash, metric_value FROM metrics_daily")
def _(spark, sf):
    """The roll-up by micro-batches of the event log, which equals the batch roll-up."""
    return text_day(streams.rolled_up(spark, tables.web_events(spark, sf)))


from . import ingestion, platform  # noqa: E402, F401  register their queries
