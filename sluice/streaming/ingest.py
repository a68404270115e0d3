"""Raw deliveries to metrics as one stream: parse, reject, drop repeats, suppress by rule, land, roll up.

A delivery is (delivery_id, source_id, body). Each micro-batch

* parses its bodies as a whole; what is no event goes to the rejects,
* drops events that were delivered before: the key is the source, an event's whole content and its
  number among equal events of its body, so a retry adds nothing, nor do events that come
  in other groups, while equal events of one body all stay,
* marks page views that another source counts (the rule of `modules.suppress`),
* lands events and rejects, each in a folder of the batch that is written anew if the batch is,
* adds to the daily metrics what is new; an identity counts by the first event of its day, of all batches.

Keys, identities and metrics are state by day (`state`): an event's key holds its time, so a repeat has the same
day, and a batch reads only the days that it has events of. Keys of rejects are in hash buckets.
Sinks and state count from the batch's manifest on, so both are exact across restarts and retries.

Defined results: an event without a time has no day; its metrics do neither. A null or empty body has
no events. Deliveries without a source are one source. Columns beside the three are dropped.
"""

from __future__ import annotations

import copy
import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import modules
from ..operators.store import increment, once
from ..sources import deliveries
from . import state
from .rollup import METRICS, SEEN, batch_delta

DELIVERY = "delivery_id long, source_id string, body string"
#: Hash buckets of the rejects' keys.
BUCKETS = 16


def _slot(day: str) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(state.NO_DAY))


def keyed(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """bodies (delivery_id, source_id, body) -> (events, rejects), both with source_id and event_key; of equal bodies of a source, one."""
    digest = F.sha2("body", 256).alias("body_hash")
    one = bodies.where(F.col("body").isNotNull()).groupBy("source_id", digest).agg(F.min("delivery_id").alias("delivery_id"), F.first("body").alias("body"))
    events, rejects = deliveries.parse(one, "source_id", "body_hash")
    content = F.sha2(F.concat_ws("\0", F.coalesce("source_id", F.lit("")), F.to_json("event")), 256)
    number = F.row_number().over(W.partitionBy("body_hash", "source_id", "content").orderBy("position"))
    events = events.withColumn("content", content).withColumn("event_key", F.concat_ws(":", "content", number)).drop("content", "body_hash")
    place = F.concat_ws(":", F.coalesce("source_id", F.lit("")), "body_hash", "position")
    return events, rejects.withColumn("event_key", F.sha2(place, 256)).drop("body_hash")


def log_rows(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of the event log from keyed events, with day and suppressed."""
    own = sources.select(F.col("id").alias("u_id"), F.col("url").alias("source_url"))
    rows = events.join(F.broadcast(own), F.col("source_id") == F.col("u_id"), "left")  # a row a source
    log = deliveries.to_log(rows, F.col("source_url"), "source_id", "event_key")
    return modules.suppress(log, sources).withColumn("day", F.to_date("occurred_at"))


KEYS = "event_key string"


def _order() -> Column:
    """delivery_id, nulls first, then position, as one number."""
    delivery = F.coalesce(F.col("delivery_id").cast("decimal(20,0)"), F.lit(Decimal(-(2**63) - 1)).cast("decimal(20,0)"))
    return delivery * F.lit(Decimal(2**31)).cast("decimal(10,0)") + F.col("position").cast("decimal(10,0)")


def _held(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def merge(batch: DataFrame, number: int, state_dir: str, sources: Callable[[SparkSession], DataFrame], fan: int = state.FAN) -> None:
    """Take a batch of deliveries into sinks and state, unless it is in them."""
    spark = batch.sparkSession
    done, before = state.latest(spark, state_dir)
    if number <= done:
        return
    held, path = copy.deepcopy(before), f"{state_dir}/parts/{number}-{uuid.uuid4().hex[:8]}"
    events, rejects = keyed(batch)
    # Parsed once: what follows reads what is written here, so a lost executor costs no second parse.
    parsed = _held(log_rows(events, sources(spark)).withColumn("slot", _slot("day")), f"{path}/parsed")
    slots = {r["slot"] for r in parsed.select("slot").distinct().collect()}  # a row for each day
    new = f"{state_dir}/events/batch={number}"
    if slots:
        once(parsed, "event_key", ["delivery_id", "position"], state.read(spark, held, "keys", KEYS, slots)).write.mode("overwrite").parquet(new)
        landed = spark.read.parquet(new)
        state.add(landed.select("event_key", "slot"), held, "keys", KEYS, path, fan)
        seen = state.read(spark, held, "seen", SEEN, slots).drop("slot")
        delta, first = batch_delta(landed.withColumn("event_id", _order()), seen, lambda first: _held(first, f"{path}/first"))
        state.add(first.withColumn("slot", _slot("day")), held, "seen", SEEN, path, fan)
        old = state.read(spark, held, "metrics", METRICS, slots).drop("slot")
        state.replace(increment(old, delta).withColumn("slot", _slot("day")), held, "metrics", path)
    bucket = F.pmod(F.xxhash64("event_key"), F.lit(BUCKETS)).cast("string")
    bad = rejects.withColumn("slot", bucket)
    once(bad, "event_key", ["delivery_id", "position"], state.read(spark, held, "reject_keys", KEYS)).write.mode("overwrite").parquet(f"{state_dir}/rejects/batch={number}")
    state.add(spark.read.parquet(f"{state_dir}/rejects/batch={number}").select("event_key", "slot"), held, "reject_keys", KEYS, path, fan)
    state.commit(spark, state_dir, number, before, held)
    state.delete(spark, f"{path}/parsed", f"{path}/first")


def sink(spark: SparkSession, state_dir: str, name: str) -> DataFrame:
    """What has landed in `events` or `rejects`: the folders of whole batches."""
    done, _ = state.latest(spark, state_dir)
    folders = [f"{state_dir}/{name}/{n}" for n in state.names(spark, f"{state_dir}/{name}") if n.startswith("batch=") and int(n[6:]) <= done]
    return spark.read.parquet(*folders).drop("slot", "batch")


def metrics(spark: SparkSession, state_dir: str) -> DataFrame:
    """The daily metrics of all whole batches."""
    return state.read(spark, state.latest(spark, state_dir)[1], "metrics", METRICS).drop("slot")


def run(spark: SparkSession, input_dir: str, state_dir: str, sources: Callable[[SparkSession], DataFrame], files_per_batch: int | None = None) -> DataFrame:
    """Take the new files of deliveries under input_dir and return the metrics; a restart goes on where the last run ended."""
    stream = spark.readStream.schema(DELIVERY)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    out = stream.parquet(input_dir).writeStream.foreachBatch(lambda batch, number: merge(batch, number, state_dir, sources))
    out.option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return metrics(spark, state_dir)
