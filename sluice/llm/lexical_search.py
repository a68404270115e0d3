"""Ranked lexical search with block-max pruning, exact to the last place.

A document's score for an item is the sum, over the item's terms with repeats, of the
term's weight times a saturated frequency (see `saturated`), all in 64-bit integers.

1. One scan of the texts writes the forward index: blocks of consecutive documents (BLOCK of
   them, fewer where texts are long), each with its documents' lengths and the counts of terms
   that some item has. Sums over the blocks give the number and length of all documents, and
   the documents that hold each term.
2. A second pass, over the index, writes for each block the greatest saturated frequency of
   each term. From these maxima follows a bound on what any document of a block can score.
3. Each item's blocks of highest bound are scored first; its tenth best score is a
   threshold. Blocks whose bound is below the threshold are never scored. The others go
   in three rounds of falling bounds, each round raising the threshold. A block whose bound
   equals the threshold is scored, as it may hold a tie of smaller doc_id. So nothing is lost.

Items are searched in batches of about QUERY_TERMS terms, so what a task and the driver hold of
them is bounded: the batch's terms, weights and thresholds. Texts are never shuffled. A block
is a unit of bounded size whatever terms it has, so a term that every document holds makes
no hot task; each task passes on the ten best of an item in a block, and Spark cuts them to ten
before the shuffle by item.

Defined results: null and empty texts and items have no terms and are in no result. Documents
without a doc_id rank behind others of equal score. Repeated rows are documents of their own, repeated items
are searched each. Of documents equal in score and doc_id any order is right. An empty table of
documents or items gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, save, slices, table

#: Documents of a block, and the counts at which a block is closed before it has so many.
BLOCK, BLOCK_COUNTS = 128, 65_536
#: Terms (with repeats) of the items that are searched at once.
QUERY_TERMS = 200_000
#: Blocks of an item that are scored first.
FIRST = 4
#: A-Z folded; what is no letter, no digit and no byte of a character beyond ASCII separates terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
NO_ID = np.iinfo(np.int64).max

FORWARD = "block long, n_docs long, n_terms long, ids array<long>, lengths array<long>, ends array<int>, terms array<int>, counts array<long>"


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return (text or b"").translate(FOLD).split()


def saturated(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A term's frequency in documents of these lengths, saturated, in billionths."""
    m = 100 - 75 + (75 * lengths * n_docs) // n_terms
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


@dataclass
class Queries:
    """Items (numbered) as runs of terms; weights are times the repeats of the term in the item."""

    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    n_vocabulary: int

    def bounds(self, values: np.ndarray) -> np.ndarray:
        """For each item, the sum of its weights times values[term]."""
        return np.add.reduceat(self.weights * values[self.terms], self.starts)


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """docs (doc_id, text) -> blocks of consecutive documents (FORWARD). Documents without a term of the vocabulary are counted only."""
    from pyspark import TaskContext

    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, made, total = held.value, 0, [0, 0]
        ids, lengths, ends, terms, counts = [], [], [0], [], []

        def close() -> pa.RecordBatch:
            columns = [[x] for x in ((TaskContext.get().partitionId() << 33) + made, *total, ids[:], lengths[:], ends[:], np.array(terms, np.int32), np.array(counts, np.int64))]
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in FORWARD.split(", ")])

        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                found = Counter(terms_of(text))
                if not found:
                    continue
                n = found.total()
                total[0] += 1
                total[1] += n
                own = [(known[t], c) for t, c in found.items() if t in known]
                if own:
                    ids.append(doc_id)
                    lengths.append(n)
                    terms += [t for t, _ in own]
                    counts += [c for _, c in own]
                    ends.append(len(terms))
                if len(ids) == BLOCK or len(terms) >= BLOCK_COUNTS:
                    yield close()
                    made, total = made + 1, [0, 0]
                    ids, lengths, ends, terms, counts = [], [], [0], [], []
        if total[0]:
            yield close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, FORWARD)


def _numpy(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    """The rows of a list column."""
    for row in batch.column(name):
        yield row.values.to_numpy(zero_copy_only=False)


def block_maxima(index: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The forward index -> (block, terms, maxima): of each term in a block its greatest saturated frequency."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, maxima = [], []
            for lengths, ends, own, counts in zip(*(_numpy(batch, c) for c in ("lengths", "ends", "terms", "counts")), strict=True):
                order = np.argsort(own, kind="stable")
                values = saturated(counts, np.repeat(lengths, np.diff(ends)), n_docs, n_terms)[order]
                distinct, at = np.unique(own[order], return_index=True)
                terms.append(distinct)
                maxima.append(np.maximum.reduceat(values, at) if len(at) else values)
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(terms, pa.list_(pa.int32())), pa.array(maxima, pa.list_(pa.int64()))], names=["block", "terms", "maxima"])

    return index.select("block", "lengths", "ends", "terms", "counts").mapInArrow(scan, "block long, terms array<int>, maxima array<long>")


def _block_bounds(batches: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[tuple[int, np.ndarray]]:
    values = np.zeros(queries.n_vocabulary, np.int64)
    for batch in batches:
        for block, terms, maxima in zip(batch.column("block").to_pylist(), _numpy(batch, "terms"), _numpy(batch, "maxima"), strict=True):
            values[terms] = maxima
            yield block, queries.bounds(values)
            values[terms] = 0


PAIR = "item int, block long, bound long"


def _pairs(item: np.ndarray, block: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(block, pa.int64()), pa.array(bound, pa.int64())], names=["item", "block", "bound"])


def best_blocks(maxima: DataFrame, queries, count: int) -> DataFrame:
    """The `count` blocks of highest bound of each item (PAIR). queries: a broadcast."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = queries.value
        at = np.arange(len(own.starts))
        bounds, blocks = np.zeros((count, len(at)), np.int64), np.zeros((count, len(at)), np.int64)
        for block, b in _block_bounds(batches, own):
            least = bounds.argmin(axis=0)
            better = np.flatnonzero(b > bounds[least, at])
            bounds[least[better], better], blocks[least[better], better] = b[better], block
        k, item = np.nonzero(bounds)
        yield _pairs(item, blocks[k, item], bounds[k, item])

    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("bound"), "block"))
    return maxima.mapInArrow(scan, PAIR).withColumn("k", place).where(F.col("k") <= count).drop("k")


def blocks_from(maxima: DataFrame, queries, least: np.ndarray) -> DataFrame:
    """All pairs of an item and a block whose bound is the item's `least` or more (PAIR)."""
    held = maxima.sparkSession.sparkContext.broadcast(np.maximum(least, 1))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b in _block_bounds(batches, queries.value):
            item = np.flatnonzero(b >= held.value)
            if len(item):
                yield _pairs(item, np.full(len(item), block), b[item])

    return maxima.mapInArrow(scan, PAIR)


def _top(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """The places of the `count` best scores above 0, ties by ascending id."""
    at = np.flatnonzero(scores)
    if len(at) > count:
        least = np.partition(scores[at], len(at) - count)[len(at) - count]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], -scores[at]))][:count]


def score_blocks(index: DataFrame, pairs: DataFrame, queries, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """The best documents (item, doc_id, score) of each item in each block that it is paired with, `top` at most a block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = queries.value
        ends_of = np.append(own.starts[1:], len(own.terms))
        where = np.full(own.n_vocabulary, -1, np.int64)
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for ids, lengths, ends, terms, counts, items in zip(*(_numpy(batch, c) for c in ("keys", "lengths", "ends", "terms", "counts", "items")), strict=True):
                doc = np.repeat(np.arange(len(ids)), np.diff(ends))
                values = saturated(counts, lengths[doc], n_docs, n_terms)
                order = np.argsort(terms, kind="stable")
                doc, values = doc[order], values[order]
                distinct, first, many = np.unique(terms[order], return_index=True, return_counts=True)
                where[distinct] = np.arange(len(distinct))
                for item in items:
                    of = slice(own.starts[item], ends_of[item])
                    at = where[own.terms[of]]
                    weights, at = own.weights[of][at >= 0], at[at >= 0]
                    scores = np.zeros(len(ids), np.int64)
                    for w, a in zip(weights, at, strict=True):  # a document has a term once
                        run = slice(first[a], first[a] + many[a])
                        scores[doc[run]] += w * values[run]
                    best = _top(scores, ids, top)
                    found.append((np.full(len(best), item), ids[best], scores[best]))
                where[distinct] = -1
            if found:
                item, doc_id, score = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc_id, pa.int64(), mask=doc_id == NO_ID), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    wanted = pairs.groupBy("block").agg(F.collect_set("item").alias("items"))  # a batch's items at most
    rows = index.withColumn("keys", F.transform("ids", lambda x: F.coalesce(x, F.lit(NO_ID)))).join(wanted, "block")
    return rows.select("keys", "lengths", "ends", "terms", "counts", "items").mapInArrow(scan, "item int, doc_id long, score long")


def _search(docs: DataFrame, items: list[tuple[int, dict[bytes, int]]], top: int) -> DataFrame:
    """items: (iid, terms with their repeats), each with a term -> iid, rank, doc_id, score."""
    spark = docs.sparkSession
    context = spark.sparkContext
    vocabulary = {t: k for k, t in enumerate(sorted({t for _, own in items for t in own}))}
    index = save(forward_index(docs, vocabulary), "forward")
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    counted = index.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # a batch's terms at most
    weight = np.zeros(len(vocabulary), np.int64)
    for term, df in zip(counted["term"].to_pylist(), counted["count"].to_pylist(), strict=True):
        weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    sizes = [len(own) for _, own in items]
    terms = np.array([vocabulary[t] for _, own in items for t in own], np.int64)
    repeats = np.array([c for _, own in items for c in own.values()], np.int64)
    queries = context.broadcast(Queries(np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64), terms, weight[terms] * repeats, len(vocabulary)))
    n_terms = max(1, n_terms)
    maxima = save(block_maxima(index, n_docs, n_terms), "maxima")

    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best, least = None, np.zeros(len(items), np.int64)

    def score(pairs: DataFrame) -> None:
        """The best of the blocks of these pairs and of those before, and the thresholds that follow."""
        nonlocal best
        found, last = score_blocks(index, pairs, queries, n_docs, n_terms, top), best
        found = found if last is None else found.unionByName(last.drop("rank"))
        best = save(found.withColumn("rank", place).where(F.col("rank") <= top), "best")
        for r in best.where(F.col("rank") == top).select("item", "score").collect():  # a batch's items at most
            least[r["item"]] = r["score"]
        if last is not None:
            discard(last)

    first = save(best_blocks(maxima, queries, FIRST), "first")
    score(first)
    todo = save(blocks_from(maxima, queries, least).join(first.select("item", "block"), ["item", "block"], "left_anti"), "todo")
    highest = np.zeros(len(items), np.int64)
    for r in todo.groupBy("item").agg(F.max("bound").alias("bound")).collect():  # a batch's items at most
        highest[r["item"]] = r["bound"]
    below, lowest = highest + 1, least.copy()
    for share in (2, 4, 0) if highest.any() else ():
        floor = np.maximum(lowest + ((highest - lowest) // share if share else 0), least)
        levels = spark.createDataFrame(zip(range(len(items)), floor.tolist(), below.tolist(), strict=True), "item int, floor long, below long")
        score(todo.join(levels, "item").where((F.col("bound") >= F.col("floor")) & (F.col("bound") < F.col("below"))))
        below = np.minimum(floor, below)
    iids = spark.createDataFrame([(k, iid) for k, (iid, _) in enumerate(items)], "item int, iid long")
    out = best.join(iids, "item").select("iid", "rank", "doc_id", "score")
    discard(index, maxima, first, todo)
    return out


def search(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> item_id, rank, doc_id, score: each item's `top` best documents with a score above 0."""
    spark = docs.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            own = [sorted(Counter(terms_of(t)).items()) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            columns = [pa.array([[t for t, _ in x] for x in own], pa.list_(pa.binary())), pa.array([[c for _, c in x] for x in own], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), *columns], names=["item_id", "terms", "repeats"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(read, "item_id long, terms array<binary>, repeats array<long>")
    queries = save(rows.where(F.size("terms") > 0).withColumn("iid", F.monotonically_increasing_id()), "queries")
    size = queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    parts = []
    n_batches = -(-size // QUERY_TERMS)
    for k in range(n_batches):
        batch = queries.where(F.pmod(F.xxhash64("iid"), F.lit(n_batches)) == k).select("iid", "terms", "repeats").toArrow()
        own = [(iid, dict(zip(t, c, strict=True))) for iid, t, c in zip(*(batch[c].to_pylist() for c in batch.column_names), strict=True)]
        if own:
            parts.append(_search(docs, own, top))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.join(queries.select("iid", "item_id"), "iid").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda s: s <> '')"
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
     s AS (SELECT count(*) FILTER (WHERE len(ws) > 0) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d),
     p AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM d) GROUP BY r, term),
     w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
     q AS (SELECT i, any_value(item_id) AS item_id, term, count(*) AS k FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY i, term),
     f AS (SELECT i, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_terms)))))::BIGINT AS score
           FROM q JOIN p ON q.term = p.term JOIN w ON w.term = p.term, s GROUP BY i, r)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r))::INT AS rank, doc_id, score FROM f WHERE score > 0) WHERE rank <= 10
"""
