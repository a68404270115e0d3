"""Connectors: what each kind of source sends, and the typed metrics that its payloads give.

`REGISTRY` has a connector for each kind that lands raw payloads. A connector is of expressions: the
body of a payload to an array of items, and an item to its key and, once repeats are dropped, to the
facts it stands for. `normalize` dispatches a table of mixed payloads on their kind in one pass; there
is one scan, whatever kinds are in it.

A record counts once, however often it was sent: the one of the newest payload stays. Kinds without
ids have a record's content for a key, whatever the order of its fields; equal ones of one payload all count, and the payload with most of
them decides. A null or blank body has no records. What can't be read, and payloads of kinds without
a connector, go to the rejects.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import modules, rollup
from . import deliveries, payloads

VALUE = "decimal(18,4)"
EVENT = "eventType string, timestamp long, path string, referrer string, deviceId string, sessionId string"
ORDER = "id string, created_at string, lines array<struct<price:decimal(18,4),discount:decimal(8,4),returned:boolean>>"


class Connector(NamedTuple):
    kind: str
    label: str
    category: str
    #: The fields of a record.
    ddl: str
    #: A body to the array of its items: structs of a text and whether it is an object, or records where a body is read as a whole; null if it can't be read.
    items: Callable[[Column], Column]
    #: A record and its text to its key; to be taken as a record it must have one.
    key: Callable[[Column, Column], Column]
    #: A record and as_of (a day) to the facts that it stands for.
    facts: Callable[[Column, Column], list[Column]]
    #: Whether keys are the sender's ids, of which the newest record stands for the others; then items are records.
    has_ids: bool


def fact(day: Column, key: Column | str, value: Column | int = 1, dimensions: Column | None = None, entity: Column | None = None) -> Column:
    """A fact adds value to its metric; with an entity it adds 1 once, for all facts of the entity."""
    return F.struct(
        day.alias("day"), (F.lit(key) if isinstance(key, str) else key).alias("metric_key"), (F.lit(rollup.ROLLUP) if dimensions is None else dimensions).alias("dimensions"),
        (F.lit(None).cast("string") if entity is None else entity).alias("entity"), (F.lit(value) if isinstance(value, int) else value).cast(VALUE).alias("value"),
    )


def day_of(text: Column, as_of: Column) -> Column:
    return F.coalesce(F.to_date(F.try_to_timestamp(text)), as_of)


def _array(body: Column, ddl: str, other: Column | None = None) -> Column:
    """The items of a body that is an array, or of the one object `other`; null if it does not parse."""
    kind = f"array<struct<{payloads._struct(ddl)}>>"
    inside = F.when(F.ltrim(body).startswith("["), body)
    if other is not None:
        inside = F.coalesce(inside, F.concat(F.lit("["), other, F.lit("]")))
    return deliveries._let(inside, lambda x: F.when(deliveries._parses(x), F.from_json(x, kind)))


def users(body: Column) -> Column:
    """A list of users or a webhook's body."""
    return _array(body, payloads.USER, deliveries.user_record(body))


def user_facts(u: Column, as_of: Column) -> list[Column]:
    """Sign-ups on the day of creation, and the users there are as of the pull."""
    day, sure = day_of(u["created_at"], as_of), (F.length(u["confirmed_at"]) > 0) | (F.length(u["email_confirmed_at"]) > 0)
    confirmed = F.when(F.coalesce(sure, F.lit(False)), "confirmed_users")
    return [fact(day, "signups"), fact(day, "signups_by_provider", 1, rollup.dims(provider=payloads.provider_of(u))), fact(as_of, "users_total"), fact(as_of, confirmed)]


def event_facts(e: Column, as_of: Column) -> list[Column]:
    """Page views and other events, by path and referrer too, and the day's visitors and sessions."""
    day = F.coalesce(F.to_date(F.timestamp_millis(e["timestamp"])), as_of)
    path, referrer = F.coalesce(e["path"], F.lit("/")), F.coalesce(F.nullif(e["referrer"], F.lit("")), F.lit("direct"))
    visitor, session = F.coalesce(e["deviceId"], F.lit(deliveries.DEVICE_DEFAULT)), F.coalesce(e["sessionId"], F.lit(deliveries.SESSION_DEFAULT))
    kind = F.when(e["eventType"] == "pageview", "page_views").otherwise("custom_events")
    return [
        fact(day, kind), fact(day, "events_by_path", 1, rollup.dims(path=path)), fact(day, "events_by_referrer", 1, rollup.dims(referrer=referrer)),
        fact(day, "unique_visitors", entity=visitor), fact(day, "sessions", entity=session),
    ]


def order_facts(o: Column, as_of: Column) -> list[Column]:
    """Orders, and their lines' sales before and after discounts, and returns, in exact decimals."""
    day, lines = day_of(o["created_at"], as_of), F.coalesce(o["lines"], F.array().cast("array<struct<price:decimal(18,4),discount:decimal(8,4),returned:boolean>>"))
    total = lambda of: F.aggregate(lines, F.lit(0).cast(VALUE), lambda a, x: (a + F.coalesce(of(x), F.lit(0)).cast(VALUE)).cast(VALUE))
    net = lambda x: x["price"] * (1 - F.coalesce(x["discount"], F.lit(0).cast("decimal(8,4)")))
    back = lambda x: F.when(x["returned"], x["price"])
    return [fact(day, "orders"), fact(day, "gross_sales", total(lambda x: x["price"])), fact(day, "net_payment", total(net)), fact(day, "refunds", total(back))]


def _content(record: Column, text: Column) -> Column:
    return F.sha2(F.to_json(F.try_parse_json(text)), 256)


def _id(record: Column, text: Column) -> Column:
    return F.when(F.length(record["id"]) > 0, record["id"])


REGISTRY = [
    Connector("vercel_web_analytics_drain", "Web analytics drain", "analytics", EVENT, deliveries.items, _content, event_facts, False),
    Connector("supabase", "Users", "users", payloads.USER, users, _id, user_facts, True),
    Connector("shopify", "Commerce", "commerce", ORDER, lambda body: _array(body, ORDER), _id, order_facts, True),
]


def connector(kind: str) -> Connector:
    for c in REGISTRY:
        if c.kind == kind:
            return c
    raise ValueError(f"Unknown connector: {kind}")


def read(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw (payload_id, source_id, kind, body) -> records (payload_id, source_id, kind, position, key, record) and rejects (payload_id, source_id, kind, position, line).

    A payload is only cut into its items within its row. What is made of an item is made after
    that, as columns, which Spark compiles; inside an array's function it would interpret them.
    record: a field for each kind, of which an item has one.
    """
    body, with_ids = F.col("body"), [c for c in REGISTRY if c.has_ids]
    of = {c.kind: f"struct<{payloads._struct(c.ddl)}>" for c in REGISTRY}
    kind = f"array<struct<text:string,ok:boolean,{','.join(f'{c.kind}:{of[c.kind]}' for c in with_ids)}>>"
    none = lambda c: F.lit(None).cast(of[c.kind]).alias(c.kind)
    item = lambda text, ok, mine=None, x=None: F.struct(text.alias("text"), ok.alias("ok"), *[x.alias(c.kind) if c is mine else none(c) for c in with_ids])
    no_text, yes = F.lit(None).cast("string"), F.lit(True)
    to_item = lambda c: (lambda x: item(no_text, yes, c, x)) if c.has_ids else (lambda x: item(x["text"], x["ok"]))
    whole = F.array(item(body, F.lit(False))).cast(kind)
    found = F.when(F.coalesce(F.length(F.regexp_replace(body, r"\s", "")), F.lit(0)) == 0, F.array().cast(kind))
    for c in REGISTRY:
        each = F.transform(c.items(body), to_item(c))
        found = found.when(F.col("kind") == c.kind, F.coalesce(each.cast(kind), whole))
    rows = raw.select("payload_id", "source_id", "kind", F.posexplode(found.otherwise(whole)).alias("position", "i"))

    def by_kind(one: Callable[[Connector], Column]) -> Column:
        return F.coalesce(*[F.when(F.col("kind") == c.kind, one(c)) for c in REGISTRY])

    text = F.col("i.text")
    record = {c.kind: F.col(f"i.{c.kind}") if c.has_ids else F.when(F.col("kind") == c.kind, F.from_json(text, c.ddl)) for c in REGISTRY}
    key = by_kind(lambda c: c.key(record[c.kind], text))
    ok = F.coalesce(F.col("i.ok") & by_kind(lambda c: c.key(record[c.kind], text).isNotNull() if c.has_ids else yes), F.lit(False))
    line = F.coalesce(text, by_kind(lambda c: F.to_json(record[c.kind])))
    place = ["payload_id", "source_id", "kind", "position"]
    return rows.where(ok).select(*place, key.alias("key"), F.struct(*[r.alias(k) for k, r in record.items()]).alias("record")), rows.where(~ok).select(*place, line.alias("line"))


def once(records: DataFrame) -> DataFrame:
    """source_id, kind, key, n, record: each record once, as its newest payload has it, and how often it counts.

    Copies combine before either shuffle, so a record that is sent very often is a row a task.
    """
    by_payload = records.groupBy("source_id", "kind", "key", "payload_id").agg(F.max_by("record", "position").alias("record"), F.count("*").alias("n"))
    newest = by_payload.groupBy("source_id", "kind", "key").agg(F.max_by("record", "payload_id").alias("record"), F.max("n").alias("n"))
    with_ids = F.col("kind").isin([c.kind for c in REGISTRY if c.has_ids])
    return newest.withColumn("n", F.when(with_ids, 1).otherwise(F.col("n")))


def bundle(records: DataFrame, as_of: str) -> DataFrame:
    """Typed metric rows: day, source_id, source_type_key, metric_key, dimensions, dimensions_hash, unit, metric_value."""
    day = F.lit(as_of).cast("date")
    facts = F.coalesce(*[F.when(F.col("kind") == c.kind, F.array(*c.facts(F.col("record")[c.kind], day))) for c in REGISTRY])
    rows = once(records).select("source_id", F.col("kind").alias("source_type_key"), "n", F.explode(facts).alias("f"))
    rows = rows.select("source_id", "source_type_key", "n", "f.*").where("metric_key IS NOT NULL")
    key = ["day", "source_id", "source_type_key", "metric_key", "dimensions"]
    each = rows.groupBy(*key, "entity").agg(F.sum(F.col("value") * F.col("n").cast("decimal(10,0)")).alias("v"))
    value = F.when(F.col("entity").isNotNull(), F.lit(1).cast(VALUE)).otherwise(F.col("v"))
    rows = each.groupBy(*key).agg(F.sum(value).cast("double").alias("metric_value"))
    usd = [k for k, u in modules.UNITS.items() if u == "usd"]
    return rollup.hashed(rows.withColumn("unit", F.when(F.col("metric_key").isin(usd), "usd").otherwise("count")))


def normalize(raw: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Mixed payloads to their typed metrics and the rejects."""
    records, rejects = read(raw)
    return bundle(records, as_of), rejects
