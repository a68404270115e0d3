"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folder of this process for each application whose session sets none.
_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares.

    The folder is the session's spark.checkpoint.dir. Only in local mode (tests) it may be
    unset, and a folder of this process is taken; on a cluster that is an error, as
    executors don't share local folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-sluice-")
        base = _OWN[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def tables_made() -> Iterator[list[DataFrame]]:
    """The list of the tables that `save` writes inside the block, in this thread: who opens it knows when they are used up."""
    made: list[DataFrame] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)
        if (outer := _MADE.get()) is not None:
            outer += made


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of df: write it to the shared folder and read it again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    saved = spark.read.schema(df.schema).parquet(path)
    saved.saved_at = path
    if (made := _MADE.get()) is not None:
        made.append(saved)
    return saved


def discard(*saved: DataFrame) -> None:
    """Delete tables that `save` wrote, once what was made of them is saved itself. Deleting one twice does no harm."""
    for df in saved:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def kept_of(made: list[DataFrame], *kept: DataFrame) -> None:
    """Delete the tables of this list but for `kept`."""
    discard(*[df for df in made if not any(df is x for x in kept)])


def text_hash(text: str = "text") -> Column:
    """With doc_id it tells rows apart by text; equal rows are alike."""
    return F.xxhash64(text)


#: Rows of a doc_id and a hash that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 400_000


def without(docs: DataFrame, gone: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text, ...) without the rows in gone, and of the rows in again one of each.

    gone, again: saved tables (doc_id, h) without repeats; h: `text_hash`. The result reads docs and these
    two small tables, nothing else that was made on the way.
    """
    h, g_doc, g_h = (unused(docs.columns, c) for c in ("_h", "_g_doc", "_g_h"))
    same = F.col("doc_id").eqNullSafe(F.col(g_doc)) & (F.col(h) == F.col(g_h))

    def join(rows: DataFrame, marks: DataFrame, how: str) -> DataFrame:
        marks = marks.toDF(g_doc, g_h)
        return rows.join(F.broadcast(marks) if counted_at_most(marks, BROADCAST_ROWS) else marks, same, how)

    rows = join(docs.withColumn(h, text_hash()), gone, "left_anti")
    if again is not None and again.take(1):
        rows = join(rows, again, "left_anti").unionByName(join(rows, again, "left_semi").dropDuplicates(["doc_id", h]))
    return rows.drop(h)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text: maximal runs without ASCII white space (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def ascii_lower(text: Column) -> Column:
    """The text with A-Z folded and nothing else: texts of ASCII alone take the faster way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


#: The one cache that a Python worker keeps from task to task, by name.
_CACHE: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], object]):
    """The cache of this name; another one that the worker holds is dropped, so caches of several operators never add up."""
    if name not in _CACHE:
        _CACHE.clear()
        _CACHE[name] = make()
    return _CACHE[name]


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept from batch to batch.

    Only a cache: it is emptied when it holds `limit` words.
    """

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def window_hashes(hashes: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """One 64-bit hash for each window: of the words at the given offsets, in order."""
    n = len(hashes) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in offsets:
        out ^= hashes[k : k + n]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of `column`, so that work arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        each = max(1, int(batch.num_rows * limit / max(limit, batch.columns[column].nbytes if isinstance(column, int) else batch.column(column).nbytes)))
        for at in range(0, batch.num_rows, each):
            yield batch.slice(at, each)


def unused(columns: list[str], name: str) -> str:
    """`name`, with as many underscores before it as it takes to clash with no column."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def counted_at_most(df: DataFrame, bound: int) -> bool:
    """Whether df has at most `bound` rows, without reading more than it must."""
    return df.limit(bound + 1).count() <= bound


def ranked(df: DataFrame, group: list[str], order: list[str], name: str, per_bucket: int = 100_000, by: str | None = None) -> DataFrame:
    """df with a column `name`: each row's place in its group, from 0 and without gaps.

    A group may hold any share of the rows, so it is dealt over hash buckets of
    `order` first: places are counted inside a bucket, and the buckets of a group get
    their first places from the (group, bucket) counts. No task holds a whole group.
    The place is stable for given rows; only rows equal in `order` may swap. Places follow
    `order` inside a bucket only, unless `by`, a column without nulls that leads `order` and
    is no value of very many rows, is given: buckets then are ranges of it with about equal
    rows (by Spark's sampling, written down), and places follow `order` throughout.
    """
    n_buckets = max(32, -(-df.count() // per_bucket))
    bucket, b, first, n = (unused(df.columns, c) for c in ("_bucket", "_b", "_first", "_n"))
    keys = [unused(df.columns, f"_g{k}") for k in range(len(group))]
    if by:
        df = save(df.repartitionByRange(n_buckets, by).withColumn(bucket, F.spark_partition_id().cast("long")), "ranges")
    else:
        df = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(n_buckets)).cast("long"))
    counts = df.groupBy(*group, bucket).agg(F.count("*").alias(n))
    firsts = counts.select(
        *[F.col(c).alias(k) for c, k in zip(group, keys, strict=True)], F.col(bucket).alias(b),
        (F.sum(n).over(W.partitionBy(*group).orderBy(bucket)) - F.col(n)).alias(first),
    )
    same = F.col(bucket) == F.col(b)
    for c, k in zip(group, keys, strict=True):
        same &= F.col(c).eqNullSafe(F.col(k))
    local = F.row_number().over(W.partitionBy(*group, bucket).orderBy(*order)).cast("long") - 1
    out = df.withColumn(name, local).join(firsts, same)
    return out.withColumn(name, F.col(name) + F.col(first)).drop(bucket, b, first, *keys)
