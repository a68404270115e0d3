"""Keyed state of a stream in the shared folder: parts in slots, with compaction and one manifest a batch.

A part (keys, identities, metrics) is kept in slots: the day of what it holds, or a hash bucket where
there is no day. A slot is a list of folders. A batch reads the slots that it touches, and no others;
what it adds is one more folder for each of these. Where that would be a slot's FAN-th, the slot is
written anew as one, so a batch never reads FAN folders of a slot, however many batches came
before. Each batch ends with a manifest that names the folders of all slots (a row for each day and part);
it counts from then on, and folders that only the manifest before named are deleted. A batch that is
run again finds its manifest and changes nothing; one that failed midway left the last manifest as it was.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: At so many folders a slot is compacted.
FAN = 4
#: A slot's rows in a batch are spread over so many tasks, so a day that holds all rows is no hot task.
SPREAD = 8
NO_DAY = "none"
Held = dict[str, dict[str, list[str]]]  # part -> slot -> folders
MANIFEST = "part string, slot string, folders array<string>"


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    fs, where = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, where = _files(spark, path)
        fs.delete(where, True)


def latest(spark: SparkSession, state_dir: str) -> tuple[int, Held]:
    """(number of the last whole batch, what its manifest holds); -1 and nothing before the first."""
    whole = [int(n) for n in names(spark, f"{state_dir}/manifest") if n.isdigit() and "_SUCCESS" in names(spark, f"{state_dir}/manifest/{n}")]
    held: Held = {}
    if not whole:
        return -1, held
    for r in spark.read.schema(MANIFEST).parquet(f"{state_dir}/manifest/{max(whole)}").collect():  # a row for each slot
        held.setdefault(r["part"], {})[r["slot"]] = list(r["folders"])
    return max(whole), held


def commit(spark: SparkSession, state_dir: str, number: int, before: Held, held: Held) -> None:
    """Write the manifest of a batch, then delete what it has replaced. The manifest before stays until the next."""
    rows = [(part, slot, folders) for part, slots in held.items() for slot, folders in slots.items()]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{state_dir}/manifest/{number}")
    of = lambda h: {f for slots in h.values() for folders in slots.values() for f in folders}
    old = [n for n in names(spark, f"{state_dir}/manifest") if n.isdigit() and int(n) < number - 1]
    delete(spark, *sorted(of(before) - of(held)), *[f"{state_dir}/manifest/{n}" for n in old])


def read(spark: SparkSession, held: Held, part: str, schema: str, slots: set[str] | None = None) -> DataFrame:
    """The rows of a part, of some slots or all, with their slot."""
    folders = [f for slot, found in held.get(part, {}).items() if slots is None or slot in slots for f in found]
    if not folders:
        return spark.createDataFrame([], f"{schema}, slot string")
    return spark.read.schema(schema).parquet(*folders).withColumn("slot", F.regexp_extract(F.col("_metadata.file_path"), "/slot=([^/]*)/", 1))


def _write(rows: DataFrame, path: str) -> list[str]:
    """Write rows in a folder for each slot, and give the slots."""
    spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "slot"]), F.lit(SPREAD))
    rows.repartition("slot", spread).write.partitionBy("slot").parquet(path)
    return [m[1] for n in names(rows.sparkSession, path) if (m := re.fullmatch("slot=(.*)", n))]


def add(rows: DataFrame, held: Held, part: str, schema: str, path: str, fan: int = FAN) -> None:
    """Add rows (the columns of schema, and slot) to a part; held then names what was written under path."""
    spark, own = rows.sparkSession, held.setdefault(part, {})
    slots = _write(rows, f"{path}/{part}")
    full = {s for s in slots if len(own.get(s, [])) >= fan - 1}
    for s in slots:
        own[s] = [*own.get(s, []), f"{path}/{part}/slot={s}"]
    if full:
        for s in _write(read(spark, held, part, schema, full), f"{path}/{part}-whole"):
            own[s] = [f"{path}/{part}-whole/slot={s}"]
        delete(spark, *[f"{path}/{part}/slot={s}" for s in sorted(full)])


def replace(rows: DataFrame, held: Held, part: str, path: str) -> None:
    """Write slots of a part anew: what rows holds stands for the whole of their slots."""
    for s in _write(rows, f"{path}/{part}"):
        held.setdefault(part, {})[s] = [f"{path}/{part}/slot={s}"]
