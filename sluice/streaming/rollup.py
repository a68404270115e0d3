"""The roll-up as a stream: exact for data of any lateness, or with a watermark.

`run` reads event files as they come, merges each micro-batch's new log rows into the
state tables in the shared folder and ends when there is no more input (or goes on, by
trigger). First-seen identities are looked up in the state, as in the batch roll-up, so
the result equals it. What a batch writes is in a folder of its attempt, and counts from
the marker on that is written last: a restart goes on from the last marker, a batch that
is run again finds its own marker and changes nothing, and one that failed midway is done
anew. Markers and checkpoint belong together, both in the state folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rollup import ROLLUP, counters, hashed
from ..operators.store import increment, once


def batch_delta(events: DataFrame, seen: DataFrame, held: Callable[[DataFrame], DataFrame] = lambda first: first) -> tuple[DataFrame, DataFrame]:
    """(metric rows that a batch adds, identities that it saw first); seen: source_id, day, kind, identity.

    held: writes a table down and reads it again, so that the identities, which both results need, are looked for once.
    An event_id of a plain type (a number) lets them combine by hash, without a sort.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("identity")) for k, c in (("unique_visitors", "anonymous_id"), ("sessions", "session_id"))]))
    rows = events.select("source_id", "day", "suppressed", "event_id", each.alias("i")).select("source_id", "day", "suppressed", "event_id", "i.*")
    key = ["source_id", "day", "kind", "identity"]
    first = rows.groupBy(*key).agg(F.min_by("suppressed", "event_id").alias("suppressed")).join(seen, key, "left_anti")
    first = held(first)
    uniques = first.where(~F.col("suppressed")).groupBy("day", "source_id", F.col("kind").alias("metric_key")).agg(F.count("*").cast("double").alias("metric_value")).withColumn("dimensions", F.lit(ROLLUP))
    return hashed(counters(events).unionByName(uniques)), first.select(*key)


SEEN = "source_id string, day date, kind string, identity string"
METRICS = "day date, source_id string, metric_key string, dimensions string, metric_value double, dimensions_hash string"


MARKER = "number long, path string, seen array<date>, metrics array<date>"


def markers(spark: SparkSession, state_dir: str) -> list[Row]:
    """The marker of each whole batch, in order: its number and folder, and the days that its parts hold."""
    try:
        rows = spark.read.schema(MARKER).parquet(f"{state_dir}/done/*").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    return sorted(rows, key=lambda r: r["number"])


def committed(spark: SparkSession, state_dir: str) -> list[tuple[int, str]]:
    """(number, folder) of the batches with a marker, in order."""
    return [(r["number"], r["path"]) for r in markers(spark, state_dir)]


def of_days(spark: SparkSession, done: list[Row], part: str, schema: str, days: set[date | None] | None = None, newest: bool = False) -> DataFrame:
    """A part of the state, seen or metrics, of some days (or all): a day's folders in all batches, or in the newest that has the day."""
    found: dict[date | None, list[str]] = {}
    for r in done:
        for d in r[part] if days is None else days.intersection(r[part]):
            found[d] = [*([] if newest else found.get(d, [])), f"{r['path']}/{part}/day={d or '__HIVE_DEFAULT_PARTITION__'}"]
    paths = [p for each in found.values() for p in each]
    if not paths:
        return spark.createDataFrame([], schema)
    columns = schema.split(", ")
    rows = spark.read.schema(", ".join(c for c in columns if c != "day date")).parquet(*paths)
    day = F.regexp_extract(F.col("_metadata.file_path"), r"/day=([0-9]{4}-[0-9]{2}-[0-9]{2})/", 1).try_cast("date")
    return rows.withColumn("day", day).select(*[c.split(" ")[0] for c in columns])


def _by_day(rows: DataFrame, path: str) -> list[date | None]:
    """Write rows in a folder for each day, and give the days."""
    rows = rows.persist()
    try:
        rows.write.partitionBy("day").parquet(path)
        return [r["day"] for r in rows.select("day").distinct().collect()]  # a row for each calendar day
    finally:
        rows.unpersist()


def merge(batch: DataFrame, number: int, state_dir: str, key: str | None = None) -> None:
    """Add a batch to the state, unless it is in it; of equal keys, the first event of all batches counts.

    Only the days that the batch holds are read and written.
    """
    session = batch.sparkSession
    done = markers(session, state_dir)
    if any(r["number"] == number for r in done):
        return
    before = [r for r in done if r["number"] < number]
    if key:
        landed = session.read.schema(f"{key} string").parquet(*[f"{r['path']}/keys" for r in before]) if before else None
        batch = once(batch, key, ["event_id"], landed)
    batch = batch.persist()
    try:
        days = {r["day"] for r in batch.select("day").distinct().collect()}
        delta, new = batch_delta(batch, of_days(session, before, "seen", SEEN, days))
        path = f"{state_dir}/batches/{number}-{uuid.uuid4().hex[:8]}"
        seen = _by_day(new, f"{path}/seen")
        if key:
            batch.where(F.col(key).isNotNull()).select(F.col(key).cast("string")).write.parquet(f"{path}/keys")
        metrics = _by_day(increment(of_days(session, before, "metrics", METRICS, days, newest=True), delta), f"{path}/metrics")
        session.createDataFrame([(number, path, seen, metrics)], MARKER).coalesce(1).write.mode("overwrite").parquet(f"{state_dir}/done/{number}")
    finally:
        batch.unpersist()


def run(spark: SparkSession, input_dir: str, schema: T.StructType, state_dir: str, files_per_batch: int | None = 1, key: str | None = None) -> DataFrame:
    """Roll up the event files under input_dir and return the metrics table.

    Each batch writes the days that it touches anew, metrics and the identities that it saw
    first; a lost batch leaves the last whole version of each day in place.
    Without files_per_batch all files that are new make one batch. With a key, a column of the
    events, an event that is sent again adds nothing; a state folder keeps to one key.
    """
    stream = spark.readStream.schema(schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    sink = stream.parquet(input_dir).writeStream.foreachBatch(lambda batch, number: merge(batch, number, state_dir, key))
    query = sink.option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return of_days(spark, markers(spark, state_dir), "metrics", METRICS, newest=True)


def watermarked_counts(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Daily event counts of a stream with bounded state; later rows are dropped."""
    rows = events.withColumn("at", F.col("occurred_at").cast("timestamp")).withWatermark("at", lateness)
    return rows.groupBy(F.window("at", "1 day").alias("w"), "source_id", "event_name").count().select(F.to_date("w.start").alias("day"), "source_id", "event_name", "count")
