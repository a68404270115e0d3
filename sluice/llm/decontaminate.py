"""Benchmark decontamination by spaced seeds, tolerant of substituted words.

Words are maximal runs of letters and digits, lower-cased. Fixed masks pick five words of
a window and ignore the others; the hashes of the picks are the seeds of items and texts.

1. The items' seeds are a table, and a Bloom filter of it (SEED_BITS bits a seed, MAX_BITS
   at most) is sent to the scan of the texts: the few texts with a seed in it are suspects.
2. Suspects' seeds are joined to the items' seeds (by a broadcast of the items' side
   only where it is counted at BROADCAST_SEEDS at most). An item laid beside a text at
   one shift is verified once, however many seeds they share there.
3. Around a hit, every window of `min_words` words or more, of any length, with `percent` equal
   words counts, and windows that overlap or touch are one stretch. All stretches are given, each
   from its first to its last equal word, so substituted words at its ends are not in its length.

The masks hit every window that counts, of items of MIN_ITEM words or more, at the default
12 words and 80 % (the tests count all cases). Items of fewer than `min_words` / 0.8 words
are met over 80 % of their words, MIN_ITEM at least; items of fewer than MIN_ITEM words
whole and without a substitution: a mask of all their words is added for each such length.
Items of fewer than `min_item_words` words take no part: `find_overlaps` gives the overlaps of
all items, `remove` leaves out those under REMOVE_WORDS words, as a stray "the" among the items
would empty the corpus. `benchmark(...).n_left_out` says how many these are.

Texts are read once and never shuffled; only suspects' seeds and words are. A passage that
very many texts share costs each of them its own hits. Seeds and Bloom filter are built by
Spark; the driver sees the filter, MAX_BITS / 8 bytes at most.

Defined results: null and empty texts hold nothing, and so do items without a word. Repeated
rows are judged alike; null doc_ids and item_ids stay null. An empty table of documents or
items gives no overlaps. Extra columns are kept by `remove`, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_of, save, slices, table, tables_made, text_hash, unused, window_hashes, without, worker_cache

MASKS = ((0, 1, 3, 4, 5), (0, 1, 3, 6, 7), (0, 2, 5, 7, 8))
MIN_ITEM = 8
#: Words that an item must have to remove documents.
REMOVE_WORDS = 4
#: Bits of the filter for each seed, at most so many in all (128 MB), and its probes for a seed.
SEED_BITS, MAX_BITS, PROBES = 64, 1 << 30, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Rows of 16 bytes.
BROADCAST_SEEDS = 1_000_000
RUN = re.compile(r"[^\W_]+")


class Words(dict):
    """Hashes of words; emptied when it holds `limit`."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, text: str | None) -> np.ndarray:
        tokens = RUN.findall((text or "").lower())
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def masks_for(lengths: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The masks of texts, if items of fewer than MIN_ITEM words have these lengths."""
    return [*MASKS, *(tuple(range(n)) for n in lengths)]


def seeds_of(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """A seed for each place of a mask; seeds of unlike masks differ."""
    salt = xxhash.xxh64_intdigest(repr(mask).encode())
    return window_hashes(words, mask) ^ np.uint64(salt)


@dataclass
class Filter:
    """A Bloom filter of seeds."""

    log_bits: int
    bits: np.ndarray  # a bit each, packed

    @staticmethod
    def places(seeds: np.ndarray, log_bits: int) -> list[np.ndarray]:
        return [(seeds * np.uint64(odd)) >> np.uint64(64 - log_bits) for odd in PROBES]

    def holds(self, seeds: np.ndarray) -> np.ndarray:
        """The places in `seeds` of those that may be in the filter."""
        maybe = np.arange(len(seeds))
        for odd in PROBES:
            at = (seeds[maybe] * np.uint64(odd)) >> np.uint64(64 - self.log_bits)
            maybe = maybe[(self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        return maybe


def _filter(seeds: DataFrame, n: int) -> Filter:
    """Built in chunks of 2 ** 15 bits, each a row of 4 KB."""
    log_bits = (min(MAX_BITS, max(1 << 15, SEED_BITS * n)) - 1).bit_length()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(Filter.places(batch.column("seed").to_numpy().view(np.uint64), log_bits)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(15)).astype(np.int32)), pa.array((at & np.uint64(32767)).astype(np.int32))], names=["chunk", "bit"])

    def chunk(rows):
        held = np.zeros(1 << 15, np.uint8)
        held[rows["bit"]] = 1
        return rows[["chunk"]].head(1).assign(bits=[np.packbits(held, bitorder="little").tobytes()])

    found = seeds.select("seed").mapInArrow(place, "chunk int, bit int").distinct().groupBy("chunk").applyInPandas(chunk, "chunk int, bits binary").collect()
    bits = np.zeros(1 << log_bits >> 3, np.uint8)
    for r in found:
        bits[r["chunk"] << 12 : (r["chunk"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return Filter(log_bits, bits)


@dataclass
class Benchmark:
    """Items (iid, item_id, own: hashes of words) and their seeds (seed, iid, item_place), saved."""

    items: DataFrame
    seeds: DataFrame
    n_seeds: int
    lengths: tuple[int, ...]  # of items under MIN_ITEM words
    filter: Filter
    n_left_out: int  # items with fewer words than asked for


def benchmark(items: DataFrame, min_item_words: int = 1) -> Benchmark:
    """items (item_id, text) of `min_item_words` words or more made ready for the join."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_cache("words", Words)
        for batch in slices(batches, "text"):
            own = [words.of(t).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(own, pa.list_(pa.int64()))], names=["item_id", "own"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, iids, places = [], [], []
            for iid, own in zip(batch.column("iid").to_pylist(), batch.column("own"), strict=True):
                own = own.values.to_numpy().view(np.uint64)
                for mask in MASKS if len(own) >= MIN_ITEM else [tuple(range(len(own)))] if len(own) else []:
                    found = seeds_of(own, mask)
                    seeds.append(found.view(np.int64))
                    places.append(np.arange(len(found)))
                    iids.append(np.full(len(found), iid))
            if seeds:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (seeds, iids, places)], names=["seed", "iid", "item_place"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "item_id long, own array<long>")
    every = save(rows.withColumn("iid", F.monotonically_increasing_id()), "items")
    held = every.where(F.size("own") >= min_item_words)
    seeds = save(held.select("iid", "own").mapInArrow(cut, "seed long, iid long, item_place long"), "seeds")
    n = seeds.count()
    lengths = held.select(F.size("own").alias("n")).where(F.col("n").between(1, MIN_ITEM - 1)).distinct().collect()  # MIN_ITEM - 1 rows at most
    return Benchmark(held, seeds, n, tuple(sorted(r["n"] for r in lengths)), _filter(seeds, n), every.count() - held.count())


HITS = "words array<long>, seeds array<long>, places array<int>"


def with_hits(docs: DataFrame, bench: Benchmark, name: str, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, and in a column `name` the suspects' words and seeds that may be an item's (others: null)."""
    held = docs.sparkSession.sparkContext.broadcast((masks_for(bench.lengths), bench.filter))
    source = docs.select(*keep, F.col("text").cast("string").alias(unused(keep, "_text")))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(name, T.StructType.fromDDL(HITS))])
    kinds = pa.struct([("words", pa.list_(pa.int64())), ("seeds", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (masks, bloom), known = held.value, worker_cache("words", Words)
        for batch in slices(batches, -1):
            out = []
            for text in batch.columns[-1].to_pylist():
                words, seeds, places = known.of(text), [], []
                for mask in masks:
                    mine = seeds_of(words, mask)
                    at = bloom.holds(mine)
                    if len(at):
                        seeds.append(mine[at].view(np.int64))
                        places.append(at)
                out.append({"words": words.view(np.int64), "seeds": np.concatenate(seeds), "places": np.concatenate(places)} if seeds else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kinds)], names=[*batch.schema.names[:-1], name])

    return source.mapInArrow(scan, schema)


def stretches(own: np.ndarray, beside: np.ndarray, min_words: int, percent: int, whole: int) -> list[tuple[int, int, int]]:
    """(start, length, equal words) of all stretches of two equally long runs of words that count.

    whole: words of the whole item. With 100 - percent gained by an equal word and percent lost
    by another, a window counts if its end stands no lower than its start. So from each start only
    the farthest such end matters, which the greatest height from a place on finds by
    bisection: all windows of any length in n log n.
    """
    same = own == beside
    if whole < MIN_ITEM:
        return [(0, whole, whole)] if len(same) == whole and same.all() else []
    least = min(min_words, max(MIN_ITEM, whole * percent // 100))
    height = np.concatenate(([0], np.cumsum(100 * same.astype(np.int64) - percent)))
    highest = np.maximum.accumulate(height[::-1])[::-1]
    start = np.arange(len(height))
    end = np.searchsorted(-highest, -height, side="right") - 1
    long = end - start >= least
    edges = np.zeros(len(same) + 1, np.int64)
    np.add.at(edges, start[long], 1)
    np.add.at(edges, end[long], -1)
    step = np.diff((np.cumsum(edges) > 0).astype(np.int8), prepend=0)
    out = []
    for low, high in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
        equal = np.flatnonzero(same[low:high])
        out.append((low + int(equal[0]), int(equal[-1] - equal[0]) + 1, len(equal)))
    return out


def overlaps(suspects: DataFrame, bench: Benchmark, min_words: int, percent: int) -> DataFrame:
    """suspects (sid, words, seeds, places), saved -> sid, item_id, doc_start, item_start, length, n_equal (in words)."""
    mine = suspects.select("sid", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("sid", F.col("s.seeds").alias("seed"), F.col("s.places").cast("long").alias("place"))
    seeds = F.broadcast(bench.seeds) if bench.n_seeds <= BROADCAST_SEEDS else bench.seeds
    hits = mine.join(seeds, "seed").select("sid", "iid", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    # Of a text, only the words beside the item go on.
    beside = F.slice("words", F.greatest(F.col("shift"), F.lit(0)).cast("int") + 1, F.greatest(F.lit(0), F.col("shift").cast("int") + F.size("own") - F.greatest(F.col("shift"), F.lit(0)).cast("int")))
    rows = hits.join(bench.items, "iid").join(suspects.select("sid", "words"), "sid").select("sid", "item_id", "shift", "own", beside.alias("beside"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for sid, item_id, shift, own, part in zip(*(batch.column(c).to_pylist() if c not in ("own", "beside") else batch.column(c) for c in ("sid", "item_id", "shift", "own", "beside")), strict=True):
                own, part = own.values.to_numpy(), part.values.to_numpy()
                first = max(0, -shift)
                for start, n, equal in stretches(own[first : first + len(part)], part[: len(own) - first], min_words, percent, len(own)):
                    found.append((sid, item_id, first + start + shift, first + start, n, equal))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["sid", "item_id", "doc_start", "item_start", "length", "n_equal"])

    return rows.mapInArrow(verify, "sid long, item_id long, doc_start long, item_start long, length long, n_equal long")


def find_overlaps(docs: DataFrame, items: DataFrame, min_words: int = 12, percent: int = 80, min_item_words: int = 1) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> doc_id, item_id, doc_start, item_start, length, n_equal (in words)."""
    bench = benchmark(items, min_item_words)
    rows = with_hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), bench, "hits", ["doc_id"]).where("hits IS NOT NULL")
    suspects = save(rows.select("doc_id", "hits.*").withColumn("sid", F.monotonically_increasing_id()), "suspects")
    return overlaps(suspects, bench, min_words, percent).join(suspects.select("sid", "doc_id"), "sid").select("doc_id", "item_id", "doc_start", "item_start", "length", "n_equal")


def remove(docs: DataFrame, items: DataFrame, min_words: int = 12, percent: int = 80, min_item_words: int = REMOVE_WORDS) -> DataFrame:
    """docs without the rows that hold a passage of an item of `min_item_words` words or more.

    All rows are written once with their hits; those without any are kept as they are, and
    only suspects meet the joins.
    """
    bench = benchmark(items, min_item_words)
    hits, sid = unused(docs.columns, "_hits"), unused(docs.columns, "_sid")
    rows = save(with_hits(docs, bench, hits, docs.columns).withColumn(sid, F.monotonically_increasing_id()), "hits")
    found = overlaps(rows.where(F.col(hits).isNotNull()).select(F.col(sid).alias("sid"), f"{hits}.*"), bench, min_words, percent)
    bad = found.select(F.col("sid").alias(sid)).distinct()
    clean = rows.where(F.col(hits).isNull()).select(*docs.columns)
    return clean.unionByName(rows.where(F.col(hits).isNotNull()).join(bad, sid, "left_anti").select(*docs.columns))


def op9_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark passage. Of what is made on the way only the ids of rows to drop stay."""
    with tables_made() as made:
        bench = benchmark(table(spark, sf_dir, "benchmark"), REMOVE_WORDS)
        rows = with_hits(docs.select("doc_id", "text", text_hash().alias("h")), bench, "hits", ["doc_id", "h"]).where("hits IS NOT NULL")
        suspects = save(rows.select("doc_id", "h", "hits.*").withColumn("sid", F.monotonically_increasing_id()), "suspects")
        found = overlaps(suspects, bench, 12, 80).select("sid").distinct()
        gone = save(suspects.select("sid", "doc_id", "h").join(found, "sid").select("doc_id", "h").distinct(), "gone")
    kept_of(made, gone)
    return without(docs, gone)
