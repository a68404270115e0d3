"""Checks of incoming events and of their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = "^[a-zA-Z0-9_.:-]+$"
MAX_PROPERTY_BYTES = 8192


def problems() -> Column:
    """The failed checks of an event, in a fixed order, joined by commas."""
    size = lambda c, low, high: ~F.coalesce(F.length(c).between(low, high), F.lit(False))
    checks = [
        ("anonymous_id", size("anonymous_id", 1, 160)),
        ("session_id", size("session_id", 1, 160)),
        ("event_name", size("event_name", 1, 80) | ~F.coalesce(F.col("event_name").rlike(NAME), F.lit(False))),
        ("path", size("path", 1, 500)),
        ("url", size("url", 1, 1200) | ~F.coalesce(F.col("url").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\\s]+"), F.lit(False))),
        ("referrer", F.coalesce(F.length("referrer") > 1200, F.lit(False))),
        ("properties", F.coalesce(F.octet_length("properties") > MAX_PROPERTY_BYTES, F.lit(False))),
    ]
    return F.array_join(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks])), ",")


UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
DATETIME = r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?Z$"
WEB_KINDS = ("website", "vercel_web_analytics_drain")


def more_problems() -> Column:
    """The failed checks of an event's optional fields: null passes, and so do properties that are an object."""
    wrong = lambda c, ok: F.col(c).isNotNull() & ~F.coalesce(ok, F.lit(False))
    checks = [
        ("source_id", wrong("source_id", F.col("source_id").rlike(UUID))),
        ("tracking_key", wrong("tracking_key", F.length("tracking_key").between(4, 120))),
        ("user_id", wrong("user_id", F.length("user_id") <= 160)),
        ("user_agent", wrong("user_agent", F.length("user_agent") <= 1000)),
        ("occurred_at", wrong("occurred_at", F.col("occurred_at").rlike(DATETIME) & F.try_to_timestamp("occurred_at").isNotNull())),
        ("properties", wrong("properties", F.ltrim("properties").startswith("{") & F.try_parse_json("properties").isNotNull())),
    ]
    return F.array_join(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks])), ",")


def accepts_events(kind: Column) -> Column:
    """Whether a source of this kind takes tracker events; an event without a source passes."""
    return kind.isNull() | kind.isin(*WEB_KINDS)


def validated(events: DataFrame) -> DataFrame:
    rows = events.withColumn("problems", problems())
    return rows.withColumn("valid", F.col("problems") == "")


def origin_allowed(origin: Column, allowed: Column) -> Column:
    """allowed: a comma-separated list; none means all, and so does no origin."""
    return origin.isNull() | allowed.isNull() | (allowed == "") | F.array_contains(F.split(allowed, ","), origin)


def resolve_source(events: DataFrame, sources: DataFrame) -> DataFrame:
    """events (source_id, tracking_key) with the source's id and kind: by id, else by key, else none.

    A given id that no source has stays as given, with no kind.
    """
    by_id = sources.select(F.col("id").alias("i_id"), F.col("type_key").alias("i_type"))
    by_key = sources.where(F.col("tracking_key").isNotNull()).select(F.col("tracking_key").alias("k_key"), F.col("id").alias("k_id"), F.col("type_key").alias("k_type"))
    rows = events.join(F.broadcast(by_id), F.col("source_id") == F.col("i_id"), "left").join(F.broadcast(by_key), F.col("source_id").isNull() & (F.col("tracking_key") == F.col("k_key")), "left")
    return rows.withColumn("resolved_id", F.coalesce("source_id", "k_id")).withColumn("resolved_type", F.coalesce("i_type", "k_type")).drop("i_id", "i_type", "k_key", "k_id", "k_type")


#: What becomes of an event, in the order of the checks.
OUTCOMES = ("invalid", "wrong_kind", "origin", "suppressed", "accepted")


def admitted(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Incoming events with all that is checked of them: problems, resolved_id, resolved_type and outcome (one of OUTCOMES).

    events: the fields of `problems` and `more_problems`, and origin. The failed checks of required and of optional
    fields come together, each once. A valid event's source is found by id, else by key; one without a source
    has neither kind nor origins to fail. A page view that the primary drain counts is stored, but adds nothing.
    Columns that resolution adds replace any of the same name.
    """
    from .modules import mark_suppressed

    found = F.array_distinct(F.filter(F.split(F.concat_ws(",", problems(), more_problems()), ","), lambda x: x != ""))
    rows = events.drop("resolved_id", "resolved_type", "outcome", "suppressed").withColumn("problems", F.array_join(found, ","))
    rows = resolve_source(rows, sources)
    rows = rows.withColumnRenamed("source_id", "given_id").withColumn("source_id", F.col("resolved_id"))
    rows = mark_suppressed(rows, sources).drop("source_id").withColumnRenamed("given_id", "source_id")
    allowed = sources.select(F.col("id").alias("o_id"), F.col("origins").alias("o_list"))
    rows = rows.join(F.broadcast(allowed), F.col("resolved_id") == F.col("o_id"), "left")
    outcome = F.when(F.col("problems") != "", "invalid").when(~accepts_events(F.col("resolved_type")), "wrong_kind").when(~origin_allowed(F.col("origin"), F.col("o_list")), "origin").when(F.col("suppressed"), "suppressed").otherwise("accepted")
    return rows.withColumn("outcome", outcome).drop("o_id", "o_list", "suppressed")


def identity_seen(probes: DataFrame, log: DataFrame) -> DataFrame:
    """probes (probe_id, source_id, day, anonymous_id, session_id) with whether the log has either identity that day.

    Two joins on equal keys with the log's distinct identities, instead of one with an OR.
    Each probe is answered by its own columns, whatever its id.
    """
    rows, hits = probes, []
    for k, c in enumerate(("anonymous_id", "session_id")):
        keys = log.select(F.col("source_id").alias(f"_s{k}"), F.col("day").alias(f"_d{k}"), F.col(c).alias(f"_i{k}")).where(F.col(f"_i{k}").isNotNull()).distinct()
        rows = rows.join(keys, F.col("source_id").eqNullSafe(F.col(f"_s{k}")) & (F.col("day") == F.col(f"_d{k}")) & (F.col(c) == F.col(f"_i{k}")), "left")
        hits.append(F.col(f"_i{k}").isNotNull())
    return rows.select("probe_id", (hits[0] | hits[1]).alias("seen"))
