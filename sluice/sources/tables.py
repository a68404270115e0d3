"""Input tables: the event log, users and raw payloads, all read from Parquet.

Every reader selects only the columns it needs, so the scan reads no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the event log's derivation.
PATHS = ["/", "/pricing", "/dashboard", "/blog", "/contact"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def web_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log; event_id is the order of ingestion.

    `suppressed` marks page views of the tracker, which the drain counts already: they
    are in the log and use up first-seen places, but add nothing to the roll-up.
    """
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    out = e.select(
        "event_id",
        F.when(user % 3 == 0, "src_drain").otherwise("src_tracker").alias("source_id"),
        F.concat(F.lit("anon_"), user).alias("anonymous_id"),
        F.concat(F.lit("sess_"), user, F.lit("_"), F.floor(F.hour("ts") / 6).cast("int")).alias("session_id"),
        F.when(F.col("event_type") == "view", "page_view").otherwise(F.col("event_type")).alias("event_name"),
        F.element_at(F.array(*map(F.lit, PATHS)), k % 5 + 1).alias("path"),
        F.when(k % 4 == 1, "").when(k % 4 == 2, "https://search.example").when(k % 4 == 3, "direct").alias("referrer"),
        F.when(k % 4 == 0, "US").alias("country"),
        F.when(user % 2 == 0, "mobile").otherwise("desktop").alias("device_type"),
        F.col("ts").alias("occurred_at"),
        F.to_date("ts").alias("day"),
    )
    return out.withColumn("suppressed", (F.col("source_id") == "src_tracker") & (F.col("event_name") == "page_view"))


WEB_EVENTS = """
web_events AS (
  SELECT *, source_id = 'src_tracker' AND event_name = 'page_view' AS suppressed FROM (
    SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'src_drain' ELSE 'src_tracker' END AS source_id, 'anon_' || user_id AS anonymous_id,
           'sess_' || user_id || '_' || (hour(ts) // 6) AS session_id, CASE WHEN event_type = 'view' THEN 'page_view' ELSE event_type END AS event_name,
           ['/', '/pricing', '/dashboard', '/blog', '/contact'][k % 5 + 1] AS path,
           CASE k % 4 WHEN 1 THEN '' WHEN 2 THEN 'https://search.example' WHEN 3 THEN 'direct' END AS referrer,
           CASE WHEN k % 4 = 0 THEN 'US' END AS country, CASE WHEN user_id % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS device_type,
           ts AS occurred_at, CAST(ts AS DATE) AS day
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)))"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user for each customer: id, created day, provider, confirmed."""
    first = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("day"))
    c = read(spark, sf_dir, "customer").select("c_custkey")
    key = F.col("c_custkey")
    return c.join(first, key == F.col("o_custkey"), "left").select(
        key.alias("user_id"), F.coalesce("day", F.lit("2024-01-30").cast("date")).alias("day"),
        F.element_at(F.array(F.lit("email"), F.lit("google"), F.lit("github")), (key % 3 + 1).cast("int")).alias("provider"), (key % 4 != 0).alias("confirmed"),
    )


USERS = """
users AS (
  SELECT c_custkey AS user_id, coalesce(f.day, DATE '2024-01-30') AS day, ['email', 'google', 'github'][c_custkey % 3 + 1] AS provider, c_custkey % 4 <> 0 AS confirmed
  FROM customer LEFT JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS day FROM orders GROUP BY 1) f ON c_custkey = o_custkey)"""


def raw_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as they land: documents, with their language as source."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("lang").alias("source_id"), F.sha2(F.col("text").cast("binary"), 256).alias("payload_hash"))


# Small dimension rows, the same in both engines.
SOURCES_SCHEMA = "id string, type_key string, display_name string, url string, status string, sync_mode string, frequency_minutes int, next_sync_at string, last_success_at string, last_webhook_at string, last_error string, created_at string, tracking_key string, origins string, scaffold boolean"
SOURCES = [
    ("src_drain", "vercel_web_analytics_drain", "Drain", "https://site.example", "healthy", "webhook", 60, None, None, "2024-01-30T10:00:00", None, "2024-01-01T00:00:00", "key_drain_0001", None, False),
    ("src_tracker", "website", "Tracker", "https://site.example", "needs_credentials", "hybrid", 60, "2024-01-30T12:00:00", "2024-01-29T09:00:00", None, None, "2024-01-02T00:00:00", "key_tracker_0002", "https://site.example,https://www.site.example", False),
    ("src_users", "supabase", "Users", "https://abc.supabase.co", "healthy", "cron", 30, "2024-01-30T23:00:00", "2024-01-30T08:30:00", None, None, "2024-01-03T00:00:00", None, None, False),
    ("src_video", "tiktok", "Video", "https://www.tiktok.com/@account", "demo", "cron", 60, None, None, None, None, "2024-01-04T00:00:00", None, "", True),
    ("src_photo", "instagram", "Photo", "https://www.instagram.com/account", "error", "hybrid", 120, "2024-01-30T11:00:00", None, None, "Token expired", "2024-01-05T00:00:00", None, None, True),
    ("src_shop", "shopify", "Shop", "https://your-store.myshopify.com", "disabled", "manual", 60, None, None, None, None, "2024-01-06T00:00:00", None, None, True),
]
RUNS_SCHEMA = "id string, source_id string, trigger string, status string, created_at string, duration_ms long"
RUNS = [(f"run_{k:02d}", SOURCES[k % 6][0], ["cron", "manual", "webhook"][k % 3], "error" if k == 6 else "running" if k == 19 else "success", f"2024-01-{11 + k:02d}T0{k % 10}:15:00", 2300 + 90 * k) for k in range(20)]
LOCKS_SCHEMA = "source_id string, owner string, expires_at string"
LOCKS = [("src_users", "worker-a", "2024-01-30T12:04:00"), ("src_tracker", "worker-b", "2024-01-30T11:50:00")]
REQUESTS_SCHEMA = "seq int, source_id string, owner string"
REQUESTS = [(1, "src_users", "worker-c"), (2, "src_tracker", "worker-c"), (3, "src_tracker", "worker-d"), (4, "src_video", "worker-d")]
#: The anchor of all ranges: the last day of the event log, and a time on it.
AS_OF, NOW = "2024-01-30", "2024-01-30T12:00:00"


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def values(name: str, data: list[tuple], schema: str) -> str:
    """The same rows as a common table expression."""
    names, kinds = zip(*(c.strip().split(" ") for c in schema.split(",")), strict=True)
    kinds = [{"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE"}[k] for k in kinds]
    one = lambda v: "NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(f"CAST({one(v)} AS {k})" for v, k in zip(r, kinds, strict=True)) + ")" for r in data)
    return f"{name}({', '.join(names)}) AS (VALUES {body})"


def sources(spark: SparkSession) -> DataFrame:
    return rows(spark, SOURCES, SOURCES_SCHEMA)


def sync_runs(spark: SparkSession) -> DataFrame:
    return rows(spark, RUNS, RUNS_SCHEMA)


SOURCES_SQL = values("sources", SOURCES, SOURCES_SCHEMA)
RUNS_SQL = values("sync_runs", RUNS, RUNS_SCHEMA)
LOCKS_SQL = values("locks", LOCKS, LOCKS_SCHEMA)
REQUESTS_SQL = values("requests", REQUESTS, REQUESTS_SCHEMA)
