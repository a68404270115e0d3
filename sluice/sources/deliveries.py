"""Drain deliveries, parsed as a whole first, with rejects and typed properties.

A body is a JSON array, one object over any number of lines, or one object a line. What
does not parse, or is no object, becomes no event: it goes to the rejects with its place.
Everything is decided within a row, by Spark's own JSON and variant functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The vendor attributes under one key of an event's properties, and the event's fields they come from.
ATTRIBUTES = [
    ("schema", "schema"), ("project_id", "projectId"), ("owner_id", "ownerId"), ("query_params", "queryParams"), ("route", "route"),
    ("os_name", "osName"), ("os_version", "osVersion"), ("client_name", "clientName"), ("client_type", "clientType"), ("client_version", "clientVersion"),
    ("vercel_environment", "vercelEnvironment"), ("vercel_url", "vercelUrl"), ("sdk_name", "sdkName"), ("sdk_version", "sdkVersion"), ("deployment", "deployment"),
]
VENDOR_KEY, SCHEMA_DEFAULT = "vercel", "vercel.analytics.v2"
DEVICE_DEFAULT, SESSION_DEFAULT = "vercel-device", "vercel-session"
EVENT = ["eventType", "eventName", "eventData", "sessionId", "deviceId", "origin", "path", "referrer", "country", "deviceType"]


def _ddl() -> str:
    names = dict.fromkeys([*EVENT, *(f for _, f in ATTRIBUTES)])
    return ", ".join([f"{n} string" for n in names] + ["timestamp long"])


def _parses(text: Column) -> Column:
    """Whether a text is one JSON value and nothing after it, which the parser alone would let pass. It is parsed once."""
    inside = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.coalesce(F.size(F.try_variant_get(inside, "$", "array<variant>")) == 1, F.lit(False))


def items(body: Column) -> Column:
    """The array of a body's items, as (text, ok); an empty body has none.

    What an array that parses holds is JSON as Spark writes it, and is not parsed again.
    """
    item = lambda text, ok: F.struct(text.alias("text"), (ok & F.ltrim(text).startswith("{")).alias("ok"))
    one = lambda text: item(text, _parses(text))

    def found(trimmed: Column) -> Column:
        parts = F.transform(F.transform(F.from_json(trimmed, "array<variant>"), lambda v: F.to_json(v)), lambda t: item(t, F.lit(True)))
        lines = F.transform(F.filter(F.transform(F.split(trimmed, "\n"), lambda x: F.trim(x)), lambda x: x != ""), one)
        alone = lambda ok: F.array(item(trimmed, ok))
        return F.when(trimmed.startswith("["), F.when(_parses(trimmed), parts).otherwise(alone(F.lit(False)))).when(_parses(trimmed), alone(F.lit(True))).otherwise(lines)

    return _let(F.trim(F.regexp_replace(body, r"^\s+|\s+$", "")), found)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parse(bodies: DataFrame, *kept: str) -> tuple[DataFrame, DataFrame]:
    """bodies (delivery_id, body) -> (events: delivery_id, position, event; rejects: delivery_id, position, line), both with the columns kept."""
    rows = bodies.select("delivery_id", *kept, F.posexplode(items(F.col("body"))).alias("position", "item"))
    good = rows.where("item.ok").select("delivery_id", *kept, "position", F.from_json("item.text", _ddl()).alias("event"))
    return good, rows.where("NOT item.ok").select("delivery_id", *kept, "position", F.col("item.text").alias("line"))


def properties(event: Column) -> Column:
    """JSON of the vendor attributes under one key, and the event's own data spread over it.

    Data that is an object gives its entries, an array its places, another value nothing,
    and text that does not parse goes under raw. Values keep their types.
    """
    data = F.nullif(event["eventData"], F.lit(""))
    attribute = lambda n, f: F.coalesce(event[f], F.lit(SCHEMA_DEFAULT)) if n == "schema" else event[f]
    vendor = F.to_json(F.struct(*[attribute(n, f).alias(n) for n, f in ATTRIBUTES]), {"ignoreNullFields": "false"})
    kind = F.substring(F.ltrim(data), 1, 1)
    entries = F.when(kind == "{", F.map_entries(F.from_json(data, "map<string,variant>")))
    entries = entries.when(kind == "[", F.transform(F.from_json(data, "array<variant>"), lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value"))))
    empty = F.array().cast("array<struct<key:string,value:string>>")
    spread = F.coalesce(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value"))), empty)
    raw = F.array(F.struct(F.lit("raw").alias("key"), F.concat(F.lit('"'), _escaped(data), F.lit('"')).alias("value")))
    texts = F.when(data.isNull(), empty).when(_parses(data), spread).otherwise(raw)
    own = F.array(F.struct(F.lit(VENDOR_KEY).alias("key"), vendor.alias("value")))
    all_ = _let(texts, lambda t: F.concat(F.when(F.exists(t, lambda e: e["key"] == VENDOR_KEY), empty).otherwise(own), t))
    pairs = F.transform(F.array_sort(all_), lambda e: F.concat(F.lit('"'), _escaped(e["key"]), F.lit('":'), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _escaped(text: Column) -> Column:
    """The inside of a JSON string; text of plain ASCII signs but quotes and backslashes is as it is."""
    return F.when(text.rlike(r"^[ !#-\[\]-~]*\z"), text).otherwise(_written(text))


def _written(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.struct(text.alias("x"))), r'^\{"x":"(?s)(.*)"\}$', "$1")


def to_log(events: DataFrame, source_url: Column, *kept: str) -> DataFrame:
    """Rows of the event log from parsed events, with the columns kept."""
    from ..functions.urls import event_url

    e = F.col("event")
    agent = F.when(F.length(e["clientName"]) > 0, F.concat(e["clientName"], F.when(F.length(e["clientVersion"]) > 0, F.concat(F.lit(" "), e["clientVersion"])).otherwise("")))
    return events.select(
        "delivery_id", "position", *kept,
        F.when(e["eventType"] == "pageview", "page_view").otherwise(F.coalesce(F.nullif(e["eventName"], F.lit("")), F.lit("custom_event"))).alias("event_name"),
        F.coalesce(e["deviceId"], F.lit(DEVICE_DEFAULT)).alias("anonymous_id"), F.coalesce(e["sessionId"], F.lit(SESSION_DEFAULT)).alias("session_id"),
        F.coalesce(e["path"], F.lit("/")).alias("path"), event_url(e["path"], e["origin"], source_url).alias("url"), e["referrer"].alias("referrer"), agent.alias("user_agent"),
        e["country"].alias("country"), e["deviceType"].alias("device_type"), properties(e).alias("properties"), F.date_format(F.timestamp_millis(e["timestamp"]), "yyyy-MM-dd'T'HH:mm:ss").alias("occurred_at"),
    )


def user_record(payload: Column) -> Column:
    """The user record of a webhook body, as JSON: the first of record, new and profile that is there, if it is an object; else the same under data."""

    def first(prefix: str) -> Column:
        found = [F.get_json_object(payload, f"{prefix}.{k}") for k in ("record", "new", "profile")]
        value = F.coalesce(*found)
        return F.when(value.startswith("{"), value)

    return F.coalesce(first("$"), first("$.data"))
