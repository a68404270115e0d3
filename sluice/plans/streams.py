"""The event log as a stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import rollup

_OWN: dict[str, str] = {}


def shared_base(spark) -> str:
    """The cluster's shared folder; in local mode, where none may be set, a folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-sluice-"))
    return base.rstrip("/")


def shared_folder(spark) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_base(spark)}/stream-{uuid.uuid4().hex}"


def rolled_up(spark, events: DataFrame, batches: int = 4) -> DataFrame:
    """Land the log in ingestion order, part by part; the stream takes each part as one batch and is started anew for the next."""
    base = shared_folder(spark)
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    step = 1 if low is None else (high - low) // batches + 1
    for k in range(batches if low is not None else 1):
        part = events if low is None else events.where(F.col("event_id").between(low + k * step, low + (k + 1) * step - 1))
        part.write.mode("append").parquet(f"{base}/log")
        rolled = rollup.run(spark, f"{base}/log", events.schema, base, None)
    return rolled
