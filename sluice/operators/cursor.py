"""Incremental reads of a source by a high-water mark that is committed with the data.

A pull reads the rows from the mark on (the filter reaches the scan), leaves out those at the mark that
have landed, and lands the others. Rows and new mark count from one manifest on: a pull that fails
before it changes nothing, and the next one reads the same rows again. Rows that come later with
the mark's own value are found, earlier ones are not: the column must grow with time of arrival.
"""

from __future__ import annotations

import copy
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import state


def mark(spark: SparkSession, state_dir: str) -> str | None:
    """The highest value that has landed."""
    return next(iter(state.latest(spark, state_dir)[1].get("mark", {})), None)


def landed(spark: SparkSession, state_dir: str) -> DataFrame | None:
    """All rows of whole pulls; none before the first."""
    folders = state.latest(spark, state_dir)[1].get("rows", {}).get("all", [])
    return spark.read.parquet(*folders) if folders else None


def land(source: DataFrame, column: str, key: str, state_dir: str) -> tuple[int, state.Held, state.Held]:
    """Write the rows that are new; they count when the manifest given back is committed."""
    spark = source.sparkSession
    number, before = state.latest(spark, state_dir)
    held, path = copy.deepcopy(before), f"{state_dir}/rows/{number + 1}-{uuid.uuid4().hex[:8]}"
    last, rows = next(iter(held.get("mark", {})), None), source.where(F.col(column).isNotNull())
    if last is not None:
        at = F.lit(last).cast(source.schema[column].dataType)
        known = landed(spark, state_dir).where(F.col(column) == at).select(key)
        rows = rows.where(F.col(column) >= at).join(known, key, "left_anti")
    rows.select(*source.columns).write.parquet(path)
    newest = spark.read.schema(source.schema).parquet(path).agg(F.max(column).cast("string")).first()[0]
    if newest is not None:
        held.setdefault("rows", {}).setdefault("all", []).append(path)
        held["mark"] = {newest: []}
    return number + 1, before, held


def pull(source: DataFrame, column: str, key: str, state_dir: str) -> DataFrame:
    """Land what is new of a source, by a column that grows and a key that tells rows of one value apart; all that has landed."""
    state.commit(source.sparkSession, state_dir, *land(source, column, key, state_dir))
    found = landed(source.sparkSession, state_dir)
    return source.where("false") if found is None else found
