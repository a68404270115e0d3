"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows are grouped by equal texts, and a group is placed whole, so copies stay together.
Only a hot group (more than FEW rows and over 1/SPLIT of a shard's share in any dimension)
is split by a hash of its ids into parts under that size.

1. The parts of hot groups, at most 2 * 3 * SPLIT * shards, are placed on the driver.
2. All other groups are dealt by a hash into bins of about GROUPS groups, and each bin is
   packed in a task of its own, against its share of the capacity that step 1 left.

In both steps the groups are taken from the largest down, and each goes to the shard where
the dot product of the group's vector with the shard's residual capacity is highest. As
every bin is balanced by itself, the shards are. The driver sees hot parts and totals only.

Tokens are those of a tokenizer, the end id included. Slots number a shard's rows without
gaps: they come from row counts of (shard, bucket), so no task holds a whole shard or a
whole group.

Defined results: a null text is an empty one with size 1 (the end of the text counts
as one byte). Null ids are legal, rows repeated in full keep a slot each. An empty
table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ranked, save, table
from .tokens import encoded, vocabulary

GROUPS = 50_000
SPLIT = 4
#: Groups of so few rows are never split.
FEW = 4
DIMS = ("size", "n_tokens", "n_rows")


def pack_vectors(items: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The bin of each item: rows of `items` and of `capacity` have one column for each dimension.

    Largest item first; it goes where the dot product with the residual capacity is highest.
    """
    mean = np.maximum(np.abs(capacity).mean(axis=0), 1e-9)
    scaled, residual = items / mean, capacity / mean
    out = np.empty(len(items), np.int64)
    for k in np.argsort(-scaled.max(axis=1, initial=0), kind="stable"):
        b = int(np.argmax(residual @ scaled[k]))
        out[k] = b
        residual[b] -= scaled[k]
    return out


def measured(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, digest, size, text_crc32, n_tokens): all that packing needs of a document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("digest"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text.alias("text"))
    schema = T.StructType([*rows.drop("text").schema.fields, T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in encoded(batches, tokenizer, 2):
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=schema.names)

    return rows.mapInArrow(count, schema)


def assign_shards(docs: DataFrame, shards: int = 16, tokenizer: str | None = None, split: int = SPLIT, groups: int = GROUPS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, size, text_crc32, n_tokens, shard, slot."""
    spark = docs.sparkSession
    rows = save(measured(docs, tokenizer or vocabulary("byte_bpe_50k.json")), "measured")
    total = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in DIMS[:2]], F.count("*").alias("n_rows"), F.approx_count_distinct("digest").alias("groups")).first()
    limit = {c: max(1, total[c] // (shards * split)) for c in DIMS}
    sums = [F.sum("size").alias("size"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows")]
    parts = F.greatest(*[F.ceil(F.col(c) / F.lit(limit[c])) for c in DIMS])
    found = save(rows.groupBy("digest").agg(*sums).withColumn("parts", F.when(F.col("n_rows") > FEW, F.least(parts, F.lit(split * shards)).cast("int")).otherwise(1)), "groups")

    # Groups over the limit: at most 3 * shards * split of them, as each fills that share of one dimension.
    hot = found.where("parts > 1").select("digest", "parts")
    salted = rows.join(F.broadcast(hot), "digest").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    pieces = salted.groupBy("digest", "part").agg(*sums).orderBy("digest", "part").collect()
    capacity = np.tile(np.array([total[c] / shards for c in DIMS], float), (shards, 1))
    vectors = np.array([[r[c] for c in DIMS] for r in pieces], float).reshape(len(pieces), len(DIMS))
    placed = pack_vectors(vectors, capacity)
    np.subtract.at(capacity, placed, vectors)
    plan = spark.createDataFrame([(bytes(r["digest"]), r["part"], int(b)) for r, b in zip(pieces, placed, strict=True)], "digest binary, part int, shard int")

    # The share of a bin in the capacity that is left is its share of what is left to place.
    left, bins = capacity.sum(axis=0), max(1, -(-total["groups"] // groups))

    def pack(bin_: pd.DataFrame) -> pd.DataFrame:
        bin_ = bin_.sort_values("digest", ignore_index=True)
        items = bin_[list(DIMS)].to_numpy(float)
        own = capacity * (items.sum(axis=0) / np.where(left > 0, left, 1))
        return pd.DataFrame({"digest": bin_["digest"], "shard": pack_vectors(items, own).astype(np.int32)})

    rest = found.where("parts = 1").withColumn("bin", F.pmod(F.xxhash64("digest"), F.lit(bins)))
    whole = rest.groupBy("bin").applyInPandas(pack, "digest binary, shard int")
    cold = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(whole, "digest").drop("digest")
    hot_rows = salted.join(F.broadcast(plan), ["digest", "part"]).select(*cold.columns)
    return ranked(save(cold.unionByName(hot_rows), "placed"), ["shard"], ["doc_id", "text_crc32", "size"], "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> DataFrame:
    """Write docs as Parquet, one folder for each shard, and return the assignment."""
    plan = save(assign_shards(docs, shards).select(F.col("doc_id").alias("s_doc"), F.col("text_crc32").alias("s_crc"), F.col("size").alias("s_size"), "shard", "slot"), "shards")
    text = F.coalesce("text", F.lit("")).cast("binary")
    keys = plan.groupBy("s_doc", "s_crc", "s_size").agg(F.min("shard").alias("shard"))
    joined = docs.join(keys, F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.crc32(text) == F.col("s_crc")) & ((F.octet_length(text) + 1) == F.col("s_size")))
    joined.drop("s_doc", "s_crc", "s_size").write.partitionBy("shard").parquet(path)
    return plan


def op4_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens")
