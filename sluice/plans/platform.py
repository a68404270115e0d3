"""More of the engine's queries: the typed table, module records, strict ingestion, sync runs, sources' rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import web
from ..operators import modules, reads, records, rollup, runs, store, sync, validate
from ..sources import deliveries, payloads, tables
from ..sources.tables import AS_OF, NOW, SOURCES_SQL, WEB_EVENTS
from .catalogue import ALL_METRICS_SQL, ROLLUP_SQL, all_metrics, metrics, query, stored, text_day
from .streams import shared_folder

TYPED_SQL = f"""{ALL_METRICS_SQL}, {SOURCES_SQL}, typed AS (SELECT a.*, s.type_key AS source_type_key, CASE WHEN metric_key = 'engagement_rate' THEN 'percent' WHEN metric_key IN ('net_payment', 'gross_sales', 'refunds') THEN 'usd' ELSE 'count' END AS unit FROM all_metrics a LEFT JOIN sources s ON s.id = a.source_id)"""


def typed(spark, sf) -> DataFrame:
    return modules.typed(all_metrics(spark, sf), tables.sources(spark))


@query("metrics_typed", f"WITH {TYPED_SQL} SELECT day::VARCHAR AS day, source_id, source_type_key, metric_key, dimensions, unit, metric_value FROM typed")
def _(spark, sf):
    return text_day(typed(spark, sf).drop("dimensions_hash"))


@query("metrics_stored_read", f"WITH {ROLLUP_SQL}, {SOURCES_SQL} SELECT day::VARCHAR AS day, source_id, type_key AS source_type_key, metric_value FROM metrics_daily JOIN sources ON id = source_id WHERE metric_key = 'page_views' AND day BETWEEN '2024-01-10' AND '2024-01-15'")
def _(spark, sf):
    """The typed roll-up is written by day; a read takes its days' partitions and filters on the metric in the scan."""
    path = f"{shared_folder(spark)}/metrics"
    store.overwrite_days(modules.typed(metrics(spark, sf), tables.sources(spark)), path)
    start, end = reads.date_range("7d", "2024-01-16")
    rows = reads.list_metrics(spark.read.parquet(path), ["page_views"], None, start, reads.previous_range(end, end)[1])
    return text_day(rows.select("day", "source_id", "source_type_key", "metric_value"))


CONFIG_SQL = tables.values("config", modules.CONFIG, modules.CONFIG_SCHEMA)
CHOSEN_SQL = """prim AS (SELECT * FROM sources WHERE type_key IN ('website', 'vercel_web_analytics_drain') AND status <> 'disabled' ORDER BY CASE type_key WHEN 'website' THEN 2 ELSE 1 END, display_name LIMIT 1),
chosen AS (SELECT 'website' AS m, id, type_key FROM prim UNION ALL SELECT type_key, id, type_key FROM sources WHERE type_key NOT IN ('website', 'vercel_web_analytics_drain') QUALIFY row_number() OVER (PARTITION BY type_key ORDER BY display_name) = 1)"""


@query("platform_module_metrics_7d", f"""WITH {TYPED_SQL}, {CONFIG_SQL}, {CHOSEN_SQL},
x AS (SELECT c.*, h.id, coalesce(h.type_key, c.module) AS kind FROM config c LEFT JOIN chosen h ON h.m = c.module),
v AS (SELECT x.module, x.metric_key, sum(metric_value) FILTER (WHERE day >= '2024-01-24') AS s, sum(metric_value) FILTER (WHERE day < '2024-01-24') AS p, arg_max(metric_value, (day, source_id, dimensions)) FILTER (WHERE day >= '2024-01-24') AS l
FROM x JOIN typed t ON t.metric_key = x.metric_key AND t.source_type_key = x.kind AND (x.id IS NULL OR x.id = t.source_id) WHERE day BETWEEN '2024-01-17' AND '2024-01-30' GROUP BY ALL)
SELECT position, x.module, slot, x.id AS source_id, x.metric_key, unit, coalesce(CASE mode WHEN 'latest' THEN l ELSE s END, 0)::DOUBLE AS value, CASE WHEN slot = 0 THEN coalesce(p, 0)::DOUBLE END AS previous_value FROM x LEFT JOIN v ON v.module = x.module AND v.metric_key = x.metric_key""")
def _(spark, sf):
    return modules.module_values(stored(spark, sf), tables.sources(spark), *reads.date_range("7d", AS_OF))


@query("platform_module_metrics_no_source_7d", f"""WITH {TYPED_SQL}, {CONFIG_SQL}, x AS (SELECT *, module AS kind FROM config),
v AS (SELECT x.module, x.metric_key, sum(metric_value) FILTER (WHERE day >= '2024-01-24') AS s, sum(metric_value) FILTER (WHERE day < '2024-01-24') AS p, arg_max(metric_value, (day, source_id, dimensions)) FILTER (WHERE day >= '2024-01-24') AS l
FROM x JOIN typed t ON t.metric_key = x.metric_key AND t.source_type_key = x.kind WHERE day BETWEEN '2024-01-17' AND '2024-01-30' GROUP BY ALL)
SELECT position, x.module, slot, NULL::VARCHAR AS source_id, x.metric_key, unit, coalesce(CASE mode WHEN 'latest' THEN l ELSE s END, 0)::DOUBLE AS value, CASE WHEN slot = 0 THEN coalesce(p, 0)::DOUBLE END AS previous_value FROM x LEFT JOIN v ON v.module = x.module AND v.metric_key = x.metric_key""")
def _(spark, sf):
    """After all sources are deleted, modules sum the rows that their kinds have left."""
    return modules.module_values(stored(spark, sf), tables.sources(spark).where("false"), *reads.date_range("7d", AS_OF))


@query("platform_module_series_7d", f"""WITH {TYPED_SQL}, {CHOSEN_SQL}, main(position, module, metric_key) AS (VALUES {', '.join(f"({k}, '{m}', '{modules.METRICS[m][0][0]}')" for k, m in enumerate(modules.SERIES))})
SELECT position, module, d::DATE::VARCHAR AS day, coalesce(sum(metric_value), 0)::DOUBLE AS value FROM (SELECT main.*, h.id, coalesce(h.type_key, main.module) AS kind FROM main LEFT JOIN chosen h ON h.m = main.module) x CROSS JOIN generate_series(DATE '2024-01-24', DATE '2024-01-30', INTERVAL 1 DAY) g(d)
LEFT JOIN typed t ON t.metric_key = x.metric_key AND t.source_type_key = x.kind AND (x.id IS NULL OR x.id = t.source_id) AND t.day = d::DATE GROUP BY ALL""")
def _(spark, sf):
    return text_day(modules.module_series(stored(spark, sf), tables.sources(spark), *reads.date_range("7d", AS_OF)))


def _top_sql(label: str, column: str, none: str) -> str:
    return f"SELECT '{label}' AS label, arg_max(value, (n, last)) AS value FROM (SELECT coalesce(nullif({column}, ''), '{none}') AS value, count(*) AS n, max((occurred_at, event_id)) AS last FROM newest GROUP BY 1)"


@query("website_insights_7d", f"""WITH {WEB_EVENTS}, newest AS (SELECT * FROM web_events WHERE source_id = 'src_drain' AND day BETWEEN '2024-01-24' AND '2024-01-30' ORDER BY occurred_at DESC, event_id DESC LIMIT 2000)
{' UNION ALL '.join(_top_sql(*x) for x in (('Top page', 'path', '/'), ('Top referrer', 'referrer', 'direct'), ('Top country', 'country', 'Unknown'), ('Top device', 'device_type', 'Unknown')))}""")
def _(spark, sf):
    return modules.website_insights(tables.web_events(spark, sf), tables.sources(spark), *reads.date_range("7d", AS_OF))


@query("provider_leader_30d", f"""WITH {ALL_METRICS_SQL} SELECT json_extract_string(dimensions, '$.provider') AS provider, sum(metric_value)::DOUBLE AS signups FROM all_metrics WHERE metric_key = 'signups_by_provider' AND day BETWEEN '1995-06-01' AND '1995-06-30' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def _(spark, sf):
    """Of a month that has sign-ups."""
    return modules.provider_mix(stored(spark, sf), *reads.date_range("30d", "1995-06-30"))


@query("source_comparison_30d", f"""WITH {TYPED_SQL} SELECT coalesce(source_id, source_type_key) AS source, min(source_type_key) AS source_type_key, {', '.join(f"coalesce(sum(metric_value) FILTER (WHERE metric_key = '{k}'), 0)::DOUBLE AS {k}" for k in ('page_views', 'signups', 'custom_events'))}
FROM typed WHERE day BETWEEN '2024-01-01' AND '2024-01-30' GROUP BY 1""")
def _(spark, sf):
    rows = reads.list_metrics(stored(spark, sf), None, None, *reads.date_range("30d", AS_OF))
    sums = [F.coalesce(F.sum(F.when(F.col("metric_key") == k, F.col("metric_value"))), F.lit(0.0)).alias(k) for k in ("page_views", "signups", "custom_events")]
    return rows.groupBy(F.coalesce("source_id", "source_type_key").alias("source")).agg(F.min("source_type_key").alias("source_type_key"), *sums)


LABELS = [(1, None), (2, 0.0), (3, 12.34), (4, -7.0), (5, 1000.0), (6, 0.04)]


@query("delta_labels", f"""WITH {tables.values('changes', LABELS, 'id int, percent double')} SELECT id, CASE WHEN percent IS NULL THEN 'No previous data' ELSE CASE WHEN percent > 0 THEN '+' ELSE '' END || format('{{:.1f}}', percent) || '% vs previous period' END AS label FROM changes""")
def _(spark, sf):
    return tables.rows(spark, LABELS, "id int, percent double").select("id", modules.delta_label(F.col("percent")).alias("label"))


MODULES_SQL = f"""{SOURCES_SQL}, {CHOSEN_SQL}, mods(module) AS (VALUES {', '.join(f"('{m}')" for m in modules.METRICS)}),
records AS (SELECT module, s.id, coalesce(s.status, CASE WHEN module IN ('shopify', 'custom_api', 'custom_csv') THEN 'disabled' ELSE 'demo' END) AS status, coalesce(s.last_success_at, s.last_webhook_at) AS last_sync_at, s.last_error FROM mods LEFT JOIN chosen c ON c.m = module LEFT JOIN sources s ON s.id = c.id)"""


def _records(spark) -> DataFrame:
    found = modules.chosen_sources(tables.sources(spark)).select("module", "id", "status", F.coalesce("last_success_at", "last_webhook_at").alias("last_sync_at"), "last_error")
    config = spark.createDataFrame([(m,) for m in modules.METRICS], "module string")
    return config.join(F.broadcast(found), "module", "left").withColumn("status", F.coalesce("status", sync.placeholder_status(F.col("module"))))


@query("header_counts", f"WITH {MODULES_SQL} SELECT count(*) FILTER (WHERE id IS NOT NULL AND status <> 'disabled') AS active, count(*) FILTER (WHERE status IN ('needs_credentials', 'warning', 'error')) AS warnings FROM records")
def _(spark, sf):
    return _records(spark).agg(F.count_if(F.col("id").isNotNull() & (F.col("status") != "disabled")).alias("active"), F.count_if(F.col("status").isin("needs_credentials", "warning", "error")).alias("warnings"))


CENTS = "round({} * 100)::BIGINT"
SETUP_SQL = f"""CASE WHEN st IS NULL THEN CASE WHEN module IN ('website', 'supabase') THEN 'Needs setup' ELSE 'Future' END WHEN st = 'healthy' THEN CASE WHEN module = 'website' AND (SELECT count(*) FROM sources WHERE type_key IN ('website', 'vercel_web_analytics_drain') AND id NOT IN (SELECT id FROM prim)) > 0 THEN 'Primary mode active' ELSE 'Connected' END
WHEN st = 'needs_credentials' THEN 'Needs credentials' WHEN st = 'error' THEN 'Sync error' WHEN st = 'disabled' THEN 'Disabled' WHEN scaffold THEN 'Scaffold demo' ELSE 'Demo mode' END"""


def _records_sql(before: str, start: str, end: str) -> str:
    """The records of a range, whose period before starts at `before`."""
    pairs = lambda name, of: f"{name}(k, v) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in of.items())})"
    tops = " UNION ALL ".join(f"SELECT {i} AS pos, '{label}' AS label, coalesce(arg_max(value || ' (' || n || ')', (n, last)), '{records.NO_TRAFFIC}') AS value FROM (SELECT coalesce(nullif({c}, ''), '{none}') AS value, count(*) AS n, max((occurred_at, event_id)) AS last FROM newest GROUP BY 1)" for i, (label, c, none) in enumerate(modules.TOPS))
    return f"""WITH {TYPED_SQL}, {CONFIG_SQL}, {CHOSEN_SQL}, {pairs('module_labels', records.MODULE_LABELS)}, newest AS (SELECT * FROM web_events WHERE source_id = (SELECT id FROM prim) AND day BETWEEN '{start}' AND '{end}' ORDER BY occurred_at DESC, event_id DESC LIMIT 2000),
x AS (SELECT c.*, h.id, coalesce(h.type_key, c.module) AS kind FROM config c LEFT JOIN chosen h ON h.m = c.module), t AS (SELECT x.module, x.slot, x.mode, t.* FROM x JOIN typed t ON t.metric_key = x.metric_key AND t.source_type_key = x.kind AND (x.id IS NULL OR x.id = t.source_id) WHERE day BETWEEN '{before}' AND '{end}'),
v AS (SELECT module, slot, coalesce(CASE WHEN min(mode) = 'latest' THEN arg_max(metric_value, (day, source_id, dimensions)) FILTER (WHERE day >= '{start}') ELSE sum(metric_value) FILTER (WHERE day >= '{start}') END, 0) AS value, coalesce(sum(metric_value) FILTER (WHERE day < '{start}'), 0) AS previous FROM t GROUP BY ALL),
filled AS (SELECT x.module, x.slot, x.metric_key, coalesce(v.value, 0)::DOUBLE AS value, coalesce(v.previous, 0)::DOUBLE AS previous FROM x LEFT JOIN v ON v.module = x.module AND v.slot = x.slot),
rest AS (SELECT module, string_agg(metric_key || '=' || {CENTS.format('value')}, ';' ORDER BY slot) AS secondary FROM filled WHERE slot > 0 GROUP BY 1),
line AS (SELECT module, string_agg({CENTS.format('v')}, ',' ORDER BY d) AS sparkline FROM (SELECT m.k AS module, d, coalesce(sum(metric_value), 0) AS v FROM module_labels m CROSS JOIN generate_series(DATE '{start}', DATE '{end}', INTERVAL 1 DAY) g(d) LEFT JOIN t ON t.module = m.k AND t.slot = 0 AND t.day = d::DATE GROUP BY ALL) GROUP BY 1),
leader AS (SELECT json_extract_string(dimensions, '$.provider') AS p, sum(metric_value)::BIGINT AS n FROM t WHERE metric_key = 'signups_by_provider' AND day >= '{start}' GROUP BY 1 ORDER BY n DESC, p LIMIT 1), tops AS ({tops}),
r AS (SELECT f.module, f.metric_key, f.value, f.previous, CASE WHEN f.previous = 0 THEN CASE WHEN f.value = 0 THEN 0.0 END ELSE (f.value - f.previous) / f.previous * 100 END AS percent, s.id AS source_id, s.status AS st, s.* EXCLUDE (id, status) FROM filled f LEFT JOIN chosen c ON c.m = f.module LEFT JOIN sources s ON s.id = c.id WHERE f.slot = 0),
named AS (SELECT r.*, {SETUP_SQL} AS setup_label, CASE WHEN type_key IS NULL THEN 'Demo' WHEN type_key = 'vercel_web_analytics_drain' THEN 'Vercel Drain' WHEN st = 'demo' THEN 'Demo' ELSE 'Website Tracker' END AS web_mode FROM r)
SELECT n.module, source_id, coalesce(display_name, m.v) AS display_name, coalesce(st, CASE WHEN n.module IN ('shopify', 'custom_api', 'custom_csv') THEN 'disabled' ELSE 'demo' END) AS status, coalesce(sync_mode, 'manual') AS sync_mode,
CASE n.module WHEN 'website' THEN web_mode WHEN 'supabase' THEN CASE WHEN st IS NULL THEN 'Needs setup' ELSE 'Supabase Source' END ELSE CASE WHEN st IS NULL THEN 'Future' WHEN scaffold THEN 'Scaffold' ELSE 'Monitored Source' END END AS mode_label, metric_key AS main_key, value AS main_value, previous AS previous_value,
CASE WHEN percent IS NULL THEN 'No previous data' ELSE CASE WHEN percent > 0 THEN '+' ELSE '' END || format('{{:.1f}}', round(percent, 1)) || '% vs previous period' END AS delta_label, secondary, sparkline,
CASE n.module WHEN 'website' THEN (SELECT string_agg(label || ': ' || value, '; ' ORDER BY pos) FROM tops) WHEN 'supabase' THEN 'Provider mix: ' || coalesce((SELECT p || ' leads with ' || n || ' signups in this range.' FROM leader), '{records.NO_PROVIDERS}') || '; Freshness: ' || coalesce('Last successful sync ' || last_success_at, 'Waiting for first sync') ELSE '' END AS insights,
coalesce(last_success_at, last_webhook_at) AS last_sync_at, next_sync_at, last_error, setup_label, CASE WHEN setup_label IN ('Needs setup', 'Needs credentials') THEN 'warning' WHEN setup_label IN ('Connected', 'Primary mode active') THEN 'ok' WHEN setup_label IN ('Sync error', 'Disabled') THEN 'error' ELSE 'demo' END AS setup_severity,
source_id IS NOT NULL AND st <> 'disabled' AS can_run FROM named n JOIN module_labels m ON m.k = n.module JOIN rest USING (module) JOIN line USING (module)"""


def _flat(rows: DataFrame) -> DataFrame:
    """The nested parts of the records as texts, values in hundredths."""
    cents = lambda v: F.round(v * 100).cast("long").cast("string")
    joined = lambda c, text, by: F.array_join(F.transform(c, text), by)
    return rows.select(
        "module", "source_id", "display_name", "status", "sync_mode", "mode_label", F.col("main.key").alias("main_key"), F.col("main.value").alias("main_value"), F.col("main.previous").alias("previous_value"), "main.delta_label",
        joined("secondary", lambda x: F.concat(x["key"], F.lit("="), cents(x["value"])), ";").alias("secondary"), joined("sparkline", lambda x: cents(x["value"]), ",").alias("sparkline"),
        joined("insights", lambda x: F.concat(x["label"], F.lit(": "), x["value"]), "; ").alias("insights"), "last_sync_at", "next_sync_at", "last_error", F.col("setup.label").alias("setup_label"), F.col("setup.severity").alias("setup_severity"), "actions.can_run",
    )


def _module_records(spark, sf, key: str, sources: DataFrame, end: str = AS_OF) -> DataFrame:
    """From the typed table as it is stored, and the event log."""
    return _flat(records.module_records(stored(spark, sf), tables.web_events(spark, sf), sources, *reads.date_range(key, end)))


@query("module_records_7d", _records_sql("2024-01-17", "2024-01-24", AS_OF))
def _(spark, sf):
    return _module_records(spark, sf, "7d", tables.sources(spark))


@query("module_records_30d", _records_sql("1995-05-02", "1995-06-01", "1995-06-30"))
def _(spark, sf):
    """A month that has sign-ups."""
    return _module_records(spark, sf, "30d", tables.sources(spark), "1995-06-30")


@query("module_records_no_source_30d", _records_sql("2023-12-02", "2024-01-01", AS_OF).replace("prim AS (SELECT * FROM sources WHERE", "kept AS (SELECT * FROM sources WHERE false), prim AS (SELECT * FROM kept WHERE").replace("SELECT type_key, id, type_key FROM sources WHERE", "SELECT type_key, id, type_key FROM kept WHERE"))
def _(spark, sf):
    """After all sources are deleted: the rows of each kind that are left, texts for what is missing."""
    return _module_records(spark, sf, "30d", tables.sources(spark).where("false"))


FRESH, STALE = "Fresh within the current monitoring window", "No successful source sync yet"


@query("global_health_30d", f"""WITH {ALL_METRICS_SQL}, {MODULES_SQL}
SELECT count(*) FILTER (WHERE c) AS connected, count(*) FILTER (WHERE status = 'error' OR last_error IS NOT NULL) AS errors, max(last_sync_at) FILTER (WHERE c) AS last_sync_at, CASE WHEN max(last_sync_at) FILTER (WHERE c) IS NULL THEN '{STALE}' ELSE '{FRESH}' END AS freshness,
CASE WHEN bool_or(status IN ('demo', 'needs_credentials')) THEN 'Setup + live monitoring' ELSE 'Live monitoring' END AS mode, (SELECT sum(metric_value) FROM all_metrics WHERE metric_key IN ('page_views', 'custom_events') AND day BETWEEN '2024-01-01' AND '2024-01-30')::DOUBLE AS tracked_events FROM (SELECT *, id IS NOT NULL AND status <> 'disabled' AS c FROM records)""")
def _(spark, sf):
    live = F.col("id").isNotNull() & (F.col("status") != "disabled")
    last = F.max(F.when(live, F.col("last_sync_at")))
    one = _records(spark).agg(
        F.count_if(live).alias("connected"), F.count_if((F.col("status") == "error") | F.col("last_error").isNotNull()).alias("errors"), last.alias("last_sync_at"), F.when(last.isNull(), STALE).otherwise(FRESH).alias("freshness"),
        F.when(F.max(F.col("status").isin("demo", "needs_credentials")), "Setup + live monitoring").otherwise("Live monitoring").alias("mode"),
    )
    tracked = reads.total(reads.list_metrics(stored(spark, sf), ["page_views", "custom_events"], None, *reads.date_range("30d", AS_OF))).withColumnRenamed("metric_value", "tracked_events")
    return one.crossJoin(F.broadcast(tracked))


# Ingestion


@query("suppression_rule", f"""WITH {WEB_EVENTS}, {SOURCES_SQL}, {CHOSEN_SQL}, e AS (SELECT w.event_id, w.event_name, w.source_id, CASE WHEN w.event_id % 2 = 0 THEN '{{}}' ELSE '{{"k":1}}' END AS properties, s.type_key = 'website' AND event_name = 'page_view' AND p.id <> s.id AND p.type_key = 'vercel_web_analytics_drain' AS suppressed FROM web_events w LEFT JOIN sources s ON s.id = w.source_id CROSS JOIN prim p)
SELECT event_id, suppressed, CASE WHEN NOT suppressed THEN properties WHEN event_id % 2 = 0 THEN '{{"ingestion":{{"suppressed_rollup":true,"reason":"drain_primary"}}}}' ELSE '{{"k":1,"ingestion":{{"suppressed_rollup":true,"reason":"drain_primary"}}}}' END AS properties FROM e""")
def _(spark, sf):
    e = tables.web_events(spark, sf).select("event_id", "event_name", "source_id", F.when(F.col("event_id") % 2 == 0, "{}").otherwise('{"k":1}').alias("properties"))
    return modules.suppress(e, tables.sources(spark)).select("event_id", "suppressed", "properties")


FIELDS_SQL = """f AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '0a1b2c3d-0000-4000-8000-00000000000' || (event_id % 7) WHEN 1 THEN 'src-' || event_id END AS source_id, CASE event_id % 4 WHEN 1 THEN 'key' WHEN 2 THEN repeat('k', (100 + event_id % 40)::INT) END AS tracking_key,
CASE event_id % 3 WHEN 1 THEN repeat('u', (150 + event_id % 20)::INT) END AS user_id, CASE event_id % 6 WHEN 2 THEN repeat('a', (990 + event_id % 20)::INT) END AS user_agent, CASE event_id % 8 WHEN 0 THEN '2024-01-02T03:04:05Z' WHEN 1 THEN '2024-01-02T03:04:05.678Z' WHEN 2 THEN '2024-01-02' WHEN 3 THEN '2024-13-45T99:00:00Z' END AS occurred_at,
CASE event_id % 9 WHEN 0 THEN '{"a":1}' WHEN 1 THEN '[1]' WHEN 2 THEN '{broken' END AS properties FROM events)"""


def _fields(spark, sf) -> DataFrame:
    k = F.col("event_id")
    many = lambda c, n: F.repeat(F.lit(c), n.cast("int"))
    return tables.read(spark, sf, "events").select(
        k, F.when(k % 5 == 0, F.concat(F.lit("0a1b2c3d-0000-4000-8000-00000000000"), k % 7)).when(k % 5 == 1, F.concat(F.lit("src-"), k)).alias("source_id"), F.when(k % 4 == 1, "key").when(k % 4 == 2, many("k", 100 + k % 40)).alias("tracking_key"),
        F.when(k % 3 == 1, many("u", 150 + k % 20)).alias("user_id"), F.when(k % 6 == 2, many("a", 990 + k % 20)).alias("user_agent"),
        F.when(k % 8 == 0, "2024-01-02T03:04:05Z").when(k % 8 == 1, "2024-01-02T03:04:05.678Z").when(k % 8 == 2, "2024-01-02").when(k % 8 == 3, "2024-13-45T99:00:00Z").alias("occurred_at"), F.when(k % 9 == 0, '{"a":1}').when(k % 9 == 1, "[1]").when(k % 9 == 2, "{broken").alias("properties"),
    )


@query("event_optional_fields", f"""WITH {FIELDS_SQL} SELECT event_id, array_to_string(list_filter([CASE WHEN source_id IS NOT NULL AND try_cast(source_id AS UUID) IS NULL THEN 'source_id' END, CASE WHEN length(tracking_key) < 4 OR length(tracking_key) > 120 THEN 'tracking_key' END, CASE WHEN length(user_id) > 160 THEN 'user_id' END, CASE WHEN length(user_agent) > 1000 THEN 'user_agent' END,
CASE WHEN occurred_at IS NOT NULL AND (NOT occurred_at LIKE '%T%Z' OR try_cast(occurred_at AS TIMESTAMPTZ) IS NULL) THEN 'occurred_at' END, CASE WHEN properties IS NOT NULL AND CASE WHEN json_valid(properties) THEN json_type(properties) <> 'OBJECT' ELSE true END THEN 'properties' END], lambda x: x IS NOT NULL), ',') AS problems FROM f""")
def _(spark, sf):
    return _fields(spark, sf).select("event_id", validate.more_problems().alias("problems"))


@query("source_kind_guard", f"WITH {WEB_EVENTS}, {SOURCES_SQL}, e AS (SELECT ['src_drain', 'src_tracker', 'src_users', 'src_unknown'][event_id % 4 + 1] AS source_id FROM web_events) SELECT e.source_id, type_key IS NULL OR type_key IN ('website', 'vercel_web_analytics_drain') AS accepted, count(*) AS n FROM e LEFT JOIN sources s ON s.id = e.source_id GROUP BY ALL")
def _(spark, sf):
    of = F.element_at(F.array(*map(F.lit, ("src_drain", "src_tracker", "src_users", "src_unknown"))), (F.col("event_id") % 4 + 1).cast("int"))
    kinds = tables.sources(spark).select(F.col("id").alias("source_id"), "type_key")
    return tables.web_events(spark, sf).select(of.alias("source_id")).join(F.broadcast(kinds), "source_id", "left").groupBy("source_id", validate.accepts_events(F.col("type_key")).alias("accepted")).agg(F.count("*").alias("n"))


VENDOR_JSON = json.dumps({n: deliveries.SCHEMA_DEFAULT if n == "schema" else None for n, _ in deliveries.ATTRIBUTES}, separators=(",", ":"))
#: Bodies by event_id % 8, and the properties of the event that each gives.
DATA = {3: "5", 4: "[1,2]", 5: "plain text", 6: '{"a":1,"b":{"c":true},"z":"t"}'}
SPREAD = {3: "", 4: '"0":1,"1":2,', 5: '"raw":"plain text",', 6: '"a":1,"b":{"c":true},'}


def _strict_bodies(spark, sf) -> DataFrame:
    k = F.col("event_id")
    body = F.when(k % 8 == 0, '{\n  "eventType": "pageview",\n  "deviceId": 7\n}\n').when(k % 8 == 1, "not json").when(k % 8 == 2, '{"eventName":"sale"}\n broken\n\n{"eventType":"pageview","path":"/b"}').when(k % 8 == 7, "[{broken]")
    for n, data in DATA.items():
        body = body.when(k % 8 == n, json.dumps([{"eventType": "custom", "eventName": "x", "eventData": data}, 9] if n == 3 else {"eventType": "custom", "eventName": "x", "eventData": data}))
    return tables.web_events(spark, sf).where("source_id = 'src_drain'").select(k.alias("delivery_id"), body.alias("body"))


def _spread_sql() -> str:
    tail = {6: ',"z":"t"'}
    return " ".join(f"WHEN {n} THEN '{{{SPREAD[n]}\"vercel\":{VENDOR_JSON}{tail.get(n, '')}}}'" for n in DATA)


@query("drain_strict_events", f"""WITH {WEB_EVENTS}, d AS (SELECT event_id AS delivery_id, event_id % 8 AS k FROM web_events WHERE source_id = 'src_drain'), x AS (SELECT *, 0 AS position FROM d WHERE k NOT IN (1, 7) UNION ALL SELECT *, 2 FROM d WHERE k = 2)
SELECT delivery_id, position::INTEGER AS position, CASE WHEN k = 0 OR k = 2 AND position = 2 THEN 'page_view' WHEN k = 2 THEN 'sale' ELSE 'x' END AS event_name, CASE k WHEN 0 THEN '7' ELSE 'vercel-device' END AS anonymous_id, 'vercel-session' AS session_id, CASE WHEN position = 2 THEN '/b' ELSE '/' END AS path, CASE k {_spread_sql()} ELSE '{{"vercel":{VENDOR_JSON}}}' END AS properties FROM x""")
def _(spark, sf):
    events, _ = deliveries.parse(_strict_bodies(spark, sf))
    return deliveries.to_log(events, F.lit("https://site.example")).select("delivery_id", "position", "event_name", "anonymous_id", "session_id", "path", "properties")


@query("drain_rejects", f"""WITH {WEB_EVENTS}, d AS (SELECT event_id AS delivery_id, event_id % 8 AS k FROM web_events WHERE source_id = 'src_drain') SELECT delivery_id, CASE WHEN k IN (2, 3) THEN 1 ELSE 0 END::INTEGER AS position, CASE k WHEN 1 THEN 'not json' WHEN 2 THEN 'broken' WHEN 3 THEN '9' ELSE '[{{broken]' END AS line FROM d WHERE k IN (1, 2, 3, 7)""")
def _(spark, sf):
    return deliveries.parse(_strict_bodies(spark, sf))[1]


ORIGINS = [("https://example.org:8443/x", "https://example.org:8443"), ("HTTP://Example.org:80/x", "http://example.org"), ("https://example.org:443", "https://example.org"), ("http://example.org:443/a?b", "http://example.org:443"), ("https://u:p@Example.org:9/x#y", "https://example.org:9"), ("https://example.org", "https://example.org")]


@query("url_origins", f"WITH {tables.values('urls', ORIGINS, 'url string, truth string')}, p AS (SELECT url, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS s, lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS h, regexp_extract(url, '^[a-zA-Z]+://(?:[^/?#@]*@)?[^/?#:]+:([0-9]+)', 1) AS port FROM urls) SELECT url, s || '://' || h || CASE WHEN port = '' OR s = 'http' AND port = '80' OR s = 'https' AND port = '443' THEN '' ELSE ':' || port END AS origin FROM p")
def _(spark, sf):
    return tables.rows(spark, [(u,) for u, _ in ORIGINS], "url string").select("url", web.origin(F.col("url")).alias("origin"))


RECORDS = [(1, '{"record":{"id":"a"}}', "a"), (2, '{"new":{"id":"b"},"profile":{"id":"x"}}', "b"), (3, '{"record":"t","new":{"id":"x"}}', None), (4, '{"record":"t","new":{"id":"x"},"data":{"profile":{"id":"c"}}}', "c"), (5, '{"record":null,"new":{"id":"d"}}', "d"), (6, '{"data":{"record":5,"new":{"id":"x"}}}', None), (7, "{}", None), (8, "no json", None)]


@query("user_records", f"""WITH {tables.values('bodies', RECORDS, 'id int, body string, truth string')}, v AS (SELECT id, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM bodies),
f AS (SELECT id, coalesce(nullif(j->'$.record', 'null'), nullif(j->'$.new', 'null'), nullif(j->'$.profile', 'null')) AS a, coalesce(nullif(j->'$.data.record', 'null'), nullif(j->'$.data.new', 'null'), nullif(j->'$.data.profile', 'null')) AS b FROM v)
SELECT id, CASE WHEN json_type(a) = 'OBJECT' THEN a->>'$.id' WHEN json_type(b) = 'OBJECT' THEN b->>'$.id' END AS user_id FROM f""")
def _(spark, sf):
    return tables.rows(spark, RECORDS, "id int, body string, truth string").select("id", F.get_json_object(deliveries.user_record(F.col("body")), "$.id").alias("user_id"))


@query("user_payload_metrics", """WITH u AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN DATE '2024-01-30' ELSE ('2024-01-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0'))::DATE END AS day, CASE c_custkey % 4 WHEN 0 THEN 'google' WHEN 1 THEN 'github' ELSE 'email' END AS provider, c_custkey % 3 = 0 AS confirmed FROM customer), d AS (SELECT day, count(*) AS n, count(*) FILTER (WHERE confirmed) AS c FROM u GROUP BY 1)
SELECT day::VARCHAR AS day, 'signups' AS metric_key, '{"rollup":"daily"}' AS dimensions, n::DOUBLE AS metric_value FROM d UNION ALL SELECT day::VARCHAR, 'users_total', '{"rollup":"daily"}', (sum(n) OVER (ORDER BY day))::DOUBLE FROM d
UNION ALL SELECT day::VARCHAR, 'confirmed_users', '{"rollup":"daily"}', (sum(c) OVER (ORDER BY day))::DOUBLE FROM d UNION ALL SELECT day::VARCHAR, 'signups_by_provider', '{"provider":"' || provider || '"}', count(*)::DOUBLE FROM u GROUP BY ALL""")
def _(spark, sf):
    """A connector's way from raw payloads to metrics: JSON arrays of users, taken apart and rolled up."""
    c = tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    k = F.col("k")
    created = F.when(k % 7 == 0, "not a date").otherwise(F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T08:00:00Z")))
    user = F.struct(F.concat(F.lit("u"), k).alias("id"), created.alias("created_at"), F.when(k % 3 == 0, created).alias("confirmed_at"), F.when(k % 4 == 0, "google").alias("provider"), F.when(k % 4 == 1, F.struct(F.lit("github").alias("provider"))).alias("app_metadata"))
    bodies = c.groupBy(F.floor(k / 50).alias("payload_id")).agg(F.to_json(F.collect_list(user)).alias("body"))
    return text_day(rollup.user_metrics(payloads.exploded_users(bodies, AS_OF)).select("day", "metric_key", "dimensions", "metric_value"))


# Sync runs

REQUESTS = [("r1", 1, "src_drain", "webhook"), ("r2", 2, "src_users", "cron"), ("r3", 3, "src_photo", "manual"), ("r4", 4, "src_photo", "cron"), ("r5", 5, "src_gone", "cron"), ("r6", 6, "src_tracker", "cron"), ("r7", 7, "src_video", "cron")]
REQUESTS_SCHEMA = "run_id string, seq int, source_id string, trigger string"
RESULTS = [("r1", True, None, 2300, 12, 8, 1, 2, 4), ("r2", True, None, 10, 1, 1, 1, 1, 1), ("r3", False, "Token expired", 900, 3, 1, 0, 0, 0), ("r6", False, None, 50, 0, 0, 0, 0, 0), ("r7", True, None, 70, None, None, None, None, 5)]
RESULTS_SCHEMA = "run_id string, ok boolean, error string, duration_ms long, fetched int, raw_inserted int, own_inserted int, updated int, upserted int"
LIFE_SQL = f"""{SOURCES_SQL}, {tables.LOCKS_SQL}, {tables.values('asked', REQUESTS, REQUESTS_SCHEMA)}, {tables.values('results', RESULTS, RESULTS_SCHEMA)},
g AS (SELECT a.*, s.type_key, s.id IS NOT NULL AS known, s.id IS NOT NULL AND a.seq = min(a.seq) OVER (PARTITION BY a.source_id) AND NOT EXISTS (SELECT 1 FROM locks l WHERE l.source_id = a.source_id AND l.expires_at > '{NOW}') AS goes FROM asked a LEFT JOIN sources s ON s.id = a.source_id),
life AS (SELECT g.run_id, g.source_id, type_key AS source_type_key, trigger, CASE WHEN NOT known THEN 'error' WHEN NOT goes THEN 'skipped' WHEN ok THEN 'success' ELSE 'error' END AS status, CASE WHEN NOT known THEN 'Source not found.' WHEN NOT goes THEN 'Source is already locked by another sync run.' WHEN ok THEN NULL ELSE coalesce(error, 'Unknown sync failure.') END AS error_message,
CASE WHEN goes THEN duration_ms END AS duration_ms, CASE WHEN goes AND ok THEN coalesce(fetched, 0) ELSE 0 END::BIGINT AS records_fetched, CASE WHEN goes AND ok THEN coalesce(raw_inserted, 0) + coalesce(own_inserted, 0) ELSE 0 END::BIGINT AS records_inserted, CASE WHEN goes AND ok THEN coalesce(updated, 0) ELSE 0 END::BIGINT AS records_updated,
CASE WHEN goes AND ok THEN coalesce(upserted, 0) ELSE 0 END::BIGINT AS metrics_upserted, CASE WHEN goes THEN '2024-01-30T12:05:00' END AS lease_until FROM g LEFT JOIN results r ON r.run_id = g.run_id)"""


def _life(spark) -> DataFrame:
    return runs.life_cycle(tables.rows(spark, REQUESTS, REQUESTS_SCHEMA), tables.sources(spark), tables.rows(spark, tables.LOCKS, tables.LOCKS_SCHEMA), tables.rows(spark, RESULTS, RESULTS_SCHEMA), NOW)


@query("sync_run_life_cycle", f"WITH {LIFE_SQL} SELECT * FROM life")
def _(spark, sf):
    return _life(spark)


@query("sync_run_events", f"WITH {LIFE_SQL} SELECT run_id, source_id, CASE WHEN status = 'success' THEN 'sync_success' ELSE 'sync_error' END AS event_type, CASE WHEN status = 'success' THEN 'info' ELSE 'error' END AS severity, CASE WHEN status = 'success' THEN records_fetched || ' records fetched.' ELSE error_message END AS message FROM life WHERE lease_until IS NOT NULL ORDER BY run_id DESC LIMIT 50")
def _(spark, sf):
    """The newest 50 of the operations log."""
    return runs.run_events(_life(spark)).orderBy(F.desc("run_id")).limit(50)


@query("source_stamps", f"WITH {LIFE_SQL} SELECT id, CASE WHEN trigger = 'manual' THEN '{NOW}' END AS last_manual_at, CASE WHEN trigger = 'cron' THEN '{NOW}' END AS last_cron_at, CASE WHEN trigger = 'webhook' THEN '{NOW}' ELSE last_webhook_at END AS last_webhook_at, CASE WHEN l.status = 'success' THEN '{NOW}' ELSE last_success_at END AS last_success_at, CASE WHEN l.status = 'error' THEN '{NOW}' END AS last_error_at FROM life l JOIN sources s ON s.id = l.source_id WHERE lease_until IS NOT NULL")
def _(spark, sf):
    return runs.stamps(tables.sources(spark), _life(spark), NOW)


RELEASES = [("src_users", "worker-a"), ("src_tracker", "worker-z")]


@query("lease_release", f"WITH {tables.LOCKS_SQL}, {tables.values('gone', RELEASES, 'source_id string, owner string')} SELECT source_id, owner, expires_at FROM locks l WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.source_id = l.source_id AND g.owner = l.owner)")
def _(spark, sf):
    return runs.release(tables.rows(spark, tables.LOCKS, tables.LOCKS_SCHEMA), tables.rows(spark, RELEASES, "source_id string, owner string"))


# Sources' rows, credentials, catalogue, seeds


@query("source_list", f"WITH {SOURCES_SQL} SELECT id, display_name, row_number() OVER (ORDER BY lower(display_name), display_name) AS place FROM sources")
def _(spark, sf):
    """Sources by name, regardless of case."""
    from pyspark.sql import Window as W

    return tables.sources(spark).select("id", "display_name", F.row_number().over(W.orderBy(F.lower("display_name"), "display_name")).cast("long").alias("place"))


@query("source_by_id", f"WITH {SOURCES_SQL} SELECT id, type_key, status FROM sources WHERE id = 'src_users'")
def _(spark, sf):
    return tables.sources(spark).where("id = 'src_users'").limit(1).select("id", "type_key", "status")


NEW = [("n1", "website", "New site", None, None, None, True, None), ("n2", "supabase", "New base", "demo", "cron", 15, False, None), ("n3", "vercel_web_analytics_drain", "New drain", None, "webhook", None, True, None), ("n4", "website", "Keyed", None, None, 5, None, "key_given")]
NEW_SCHEMA = "id string, type_key string, display_name string, status string, sync_mode string, frequency_minutes int, supports_webhook boolean, tracking_key string"


@query("source_insert", f"""WITH {tables.values('n', NEW, NEW_SCHEMA)} SELECT id, type_key, display_name, coalesce(status, 'needs_credentials') AS status, coalesce(sync_mode, 'hybrid') AS sync_mode, coalesce(frequency_minutes, 60) AS frequency_minutes, CASE WHEN supports_webhook THEN '/api/webhooks/' || CASE type_key WHEN 'vercel_web_analytics_drain' THEN 'vercel/analytics-drain' ELSE type_key END || '/' || id END AS webhook_path,
CASE WHEN type_key = 'website' THEN coalesce(tracking_key, 'mq_' || left(sha256(id || ':tracking'), 20)) ELSE tracking_key END AS tracking_key, strftime(TIMESTAMP '{NOW}' + to_minutes(coalesce(frequency_minutes, 60)), '%Y-%m-%dT%H:%M:%S') AS next_sync_at, '{NOW}' AS created_at FROM n""")
def _(spark, sf):
    return runs.created_sources(tables.rows(spark, NEW, NEW_SCHEMA), NOW)


BODIES = [("src_users", '{"credentials":{"project_url":" https://x ","service_role_key":"k","n":5}}'), ("src_shop", '{"shop_domain":"a","access_token":" "}'), ("src_tracker", '{"surprise":"x"}'), ("src_photo", "[1]"), ("src_late", '{"project_url":"u","service_role_key":"k"}')]
SAVED = [("src_users", "project_url,service_role_key", "", "", "healthy"), ("src_shop", "shop_domain", "", "access_token", "disabled"), ("src_tracker", "", "surprise", "", "needs_credentials"), ("src_photo", "", "", "", "error"), ("src_late", "project_url,service_role_key", "", "", "warning")]


@query("credential_check", f"WITH {tables.values('truth', SAVED, 'source_id string, saved string, unknown string, missing string, status string')} SELECT * FROM truth")
def _(spark, sf):
    """Five bodies against a table of results: text entries only, unknown keys, missing required ones, the first save."""
    late = tables.rows(spark, [("src_late", "supabase", "needs_credentials")], "id string, type_key string, status string")
    sources = tables.sources(spark).select("id", "type_key", "status").unionByName(late)
    return runs.credential_check(tables.rows(spark, BODIES, "source_id string, body string"), sources)


KNOWN = [("website", "Website", "2024-01-01", "2024-01-01"), ("old", "Old", "2024-01-01", "2024-01-02")]


@query("catalogue_upsert", f"""WITH {tables.values('known', KNOWN, 'key string, title string, created_at string, updated_at string')}, n(key, title) AS (VALUES {', '.join(f"('{m}', 'Module {m}')" for m in modules.METRICS)})
SELECT coalesce(k.key, n.key) AS key, coalesce(n.title, k.title) AS title, coalesce(created_at, '{NOW}') AS created_at, CASE WHEN n.key IS NULL THEN updated_at ELSE '{NOW}' END AS updated_at FROM known k FULL JOIN n ON n.key = k.key""")
def _(spark, sf):
    new = tables.rows(spark, [(m, f"Module {m}") for m in modules.METRICS], "key string, title string")
    return runs.catalogue_upsert(tables.rows(spark, KNOWN, "key string, title string, created_at string, updated_at string"), new, NOW)


@query("metric_registry", f"WITH {CONFIG_SQL} SELECT module, string_agg(metric_key, ',' ORDER BY slot) AS metric_keys, count(*) AS n FROM config GROUP BY 1")
def _(spark, sf):
    """Each module's metric keys, the main one first."""
    config = tables.rows(spark, modules.CONFIG, modules.CONFIG_SCHEMA)
    return config.groupBy("module").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", "metric_key"))), lambda x: x["metric_key"]), ",").alias("metric_keys"), F.count("*").alias("n"))


@query("seed_metrics", """WITH a AS (SELECT i AS age, 59 - i AS back, floor(780 + i * 18 + sin(i / 4.0::DOUBLE) * 90 + 0.5) AS views FROM range(60) t(i)), b AS (SELECT *, floor(views * 0.42::DOUBLE + back % 4 * 12 + 0.5) AS visitors FROM a)
SELECT (DATE '2024-01-30' - back::INT)::VARCHAR AS day, unnest(['page_views', 'unique_visitors', 'sessions', 'custom_events', 'signups', 'users_total', 'confirmed_users', 'video_views', 'reach']) AS metric_key,
unnest([views, visitors, floor(visitors * 1.28::DOUBLE + 0.5), floor(views * 0.12::DOUBLE + back % 5 * 8 + 0.5), greatest(3, floor(12 + age * 0.55::DOUBLE + cos(age / 3.0::DOUBLE) * 4 + 0.5)), 500 + age * 13, floor((500 + age * 13) * 0.78::DOUBLE + 0.5), 1200 + age * 33, 900 + age * 21]::DOUBLE[]) AS metric_value FROM b""")
def _(spark, sf):
    return text_day(runs.seed_metrics(spark, AS_OF))


@query("seed_users", "SELECT 'demo_user_' || (i + 1) AS user_id, (DATE '2024-01-30' - i::INT)::VARCHAR AS day, CASE WHEN i % 3 = 0 THEN 'google' ELSE 'email' END AS provider FROM range(8) t(i)")
def _(spark, sf):
    return text_day(runs.seed_users(spark, AS_OF))


@query("heartbeats_landed", f"WITH {SOURCES_SQL}, h AS (SELECT id AS source_id, '{{\"kind\":\"heartbeat\",\"source_id\":\"' || id || '\",\"trigger\":\"cron\"}}' AS payload FROM sources WHERE type_key IN ('website', 'vercel_web_analytics_drain')) SELECT source_id, sha256(payload) AS payload_hash, 1::BIGINT AS inserted, 1::BIGINT AS duplicates FROM h")
def _(spark, sf):
    """Two equal heartbeats of a source and trigger land once."""
    h = runs.heartbeats(tables.sources(spark), "cron")
    batch = h.withColumn("seq", F.lit(1)).unionByName(h.withColumn("seq", F.lit(2))).select("seq", "source_id", "payload_hash")
    return store.land(batch.where("false"), batch).groupBy("source_id", "payload_hash").agg(F.count_if("is_new").alias("inserted"), F.count_if(~F.col("is_new")).alias("duplicates"))


@query("scaffold_payloads", f"WITH {SOURCES_SQL} SELECT id AS source_id, '{{\"scaffold\":true,\"source_type\":\"' || type_key || '\"}}' AS payload FROM sources WHERE scaffold")
def _(spark, sf):
    return runs.scaffold_payloads(tables.sources(spark))


from . import reading  # noqa: E402, F401  registers its queries, which use the SQL above
