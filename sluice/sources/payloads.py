"""Bodies as they come in: drain deliveries and user or profile payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import store

DRAIN = "eventType string, eventName string, eventData string, timestamp long, sessionId string, deviceId string, origin string, path string, referrer string, country string, deviceType string, clientName string, clientVersion string, osName string, route string, schema string"
USER = "id string, created_at string, confirmed_at string, email_confirmed_at string, provider string, app_metadata struct<provider:string>, raw_app_meta_data struct<provider:string>"
#: Vendor attributes that go under one key of the properties: property name and event field.
VENDOR = [("client_name", "clientName"), ("client_version", "clientVersion"), ("os_name", "osName"), ("route", "route")]


def parse_bodies(bodies: DataFrame, *kept: str) -> DataFrame:
    """bodies (delivery_id, body) -> delivery_id, position, event. A JSON array, one object, or one object a line.

    A line that does not parse is an event of nulls; an empty body has none. Columns in kept are passed on.
    """
    body = F.trim("body")
    as_array = F.from_json(body, f"array<struct<{', '.join(x.strip().replace(' ', ':') for x in DRAIN.split(','))}>>")
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    as_lines = F.transform(lines, lambda x: F.from_json(x, DRAIN))
    events = F.when(body.startswith("["), as_array).otherwise(as_lines)
    return bodies.select("delivery_id", *kept, F.posexplode(events).alias("position", "event"))


def parse_once(bodies: DataFrame, landed: DataFrame | None = None) -> DataFrame:
    """parse_bodies with event_key, each key once and none of landed (event_key): a delivery sent again adds nothing.

    external_id is no key: other events of a session may share its millisecond. The key is an event's whole
    content and its number among equal events of its body, so equal events of one delivery all stay, and
    a retry may group events anew. A line that does not parse has its body and place for content.
    """
    one = bodies.groupBy("body").agg(F.min("delivery_id").alias("delivery_id")).withColumn("body_hash", F.sha2("body", 256))
    content = F.coalesce(F.nullif(F.to_json("event"), F.lit("{}")), F.concat_ws(":", "body_hash", "position"))
    events = parse_bodies(one, "body_hash").withColumn("content", F.sha2(content, 256))
    number = F.row_number().over(W.partitionBy("body_hash", "content").orderBy("position"))
    keyed = events.withColumn("event_key", F.concat_ws(":", "content", number))
    return store.once(keyed, "event_key", ["delivery_id", "body_hash", "position"], landed).select("delivery_id", "position", "event", "event_key")


def drain_events(parsed: DataFrame, source_url: Column) -> DataFrame:
    """Events of the log from parsed deliveries; an event_key is passed on."""
    from ..functions.web import resolve_url

    e = F.col("event")
    or_else = lambda c, d: F.coalesce(e[c], F.lit(d))
    agent = F.when(F.length(e["clientName"]) > 0, F.concat(e["clientName"], F.when(F.length(e["clientVersion"]) > 0, F.concat(F.lit(" "), e["clientVersion"])).otherwise("")))
    return parsed.select(
        "delivery_id", "position",
        F.when(e["eventType"] == "pageview", "page_view").otherwise(F.coalesce(F.nullif(e["eventName"], F.lit("")), F.lit("custom_event"))).alias("event_name"),
        or_else("deviceId", "drain-device").alias("anonymous_id"), or_else("sessionId", "drain-session").alias("session_id"), or_else("path", "/").alias("path"),
        resolve_url(e["path"], e["origin"], source_url).alias("url"), agent.alias("user_agent"), properties(e).alias("properties"),
        F.date_format(F.timestamp_millis(e["timestamp"]), "yyyy-MM-dd'T'HH:mm:ss").alias("occurred_at"),
        F.concat_ws(":", or_else("eventType", "event"), F.coalesce(e["timestamp"].cast("string"), F.lit("0")), or_else("deviceId", "unknown"), or_else("sessionId", "unknown")).alias("external_id"),
        *[c for c in parsed.columns if c == "event_key"],
    )


def properties(e: Column) -> Column:
    """A map: the vendor attributes as JSON under one key, then the event's own data, which may replace it; what isn't an object goes under raw."""
    vendor = F.create_map(F.lit("vendor"), F.to_json(F.struct(*[e[f].alias(n) for n, f in VENDOR])))
    own = F.from_json(e["eventData"], "map<string,string>")
    raw = F.create_map(F.lit("raw"), e["eventData"])
    is_object = F.trim(e["eventData"]).startswith("{") & F.expr("try_parse_json(event.eventData)").isNotNull()
    data = F.when(F.length(e["eventData"]) > 0, F.when(is_object, own).otherwise(raw)).otherwise(F.expr("map()").cast("map<string,string>"))
    kept = F.map_filter(vendor, lambda k, v: ~F.map_contains_key(data, k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, data)))))


def profile_record(payload: Column) -> Column:
    """The user record of a webhook body: record, new or profile, at the top or under data."""
    paths = [f"$.{p}{k}" for p in ("", "data.") for k in ("record", "new", "profile")]
    found = [F.get_json_object(payload, p) for p in paths]
    return F.coalesce(*[F.when(x.startswith("{"), x) for x in found])


def provider_of(user: Column) -> Column:
    return F.coalesce(F.nullif(user["provider"], F.lit("")), user["app_metadata"]["provider"], user["raw_app_meta_data"]["provider"], F.lit("email"))


def exploded_users(payloads: DataFrame, as_of: str) -> DataFrame:
    """payloads (payload_id, body: JSON array of users) -> one row a user."""
    users = F.from_json("body", f"array<struct<{_struct(USER)}>>")
    rows = payloads.select("payload_id", F.explode(users).alias("u"))
    u = F.col("u")
    day = F.coalesce(F.to_date(F.try_to_timestamp(u["created_at"])), F.lit(as_of).cast("date"))
    confirmed = (F.length(u["confirmed_at"]) > 0) | (F.length(u["email_confirmed_at"]) > 0)
    return rows.select("payload_id", u["id"].alias("user_id"), day.alias("day"), provider_of(u).alias("provider"), F.coalesce(confirmed, F.lit(False)).alias("confirmed"))


def _struct(ddl: str) -> str:
    import re

    return re.sub(r"(^|, )(\w+) ", r"\1\2:", ddl)
