"""Best-fit packing of token pieces into sequences of a fixed capacity.

Texts become pieces: only one longer than the capacity is cut, into pieces of the
capacity, the first of which may be shorter. What packing needs of a piece is its length,
so the corpus comes down to one count for each length (`capacity` rows at most), and the
packer works on counts: runs of sequences filled alike are one step. It pairs the
large lengths (over a third of the capacity) at most twice a sequence, the longest first
with the longest partner that still fits; smaller lengths then go, the longest first,
into the tightest gap that takes them, and open new sequences where there is none.

The result is a list of runs (length, first rank, count, first sequence, offset); a
piece finds its run by its rank among the pieces of its length. Ranks come from counts
of hash buckets, so a length that a third of all pieces share is no hot task, and ids
don't move: only lengths and keys are shuffled.

Defined results: a null text is an empty one (a piece of the end id alone). Null and
repeated doc_ids are legal. An empty table gives no sequences. `pack` keeps extra
columns; lengths outside 1 to capacity are an error.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, save, table, unused
from .tokens import encoded, vocabulary

Run = tuple[int, int, int, int, int]


def pack_lengths(counts: dict[int, int], capacity: int) -> list[Run]:
    """Runs (length, first rank, count, first sequence, offset) that place all pieces.

    counts: pieces of each length. The number of runs depends on the capacity and on how
    often counts run out, not on the number of pieces.
    """
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("a length is outside 1 to capacity")
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = defaultdict(int)
    runs: list[Run] = []
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # free space -> runs of sequences (first, count)
    free: list[int] = []  # the keys of gaps, ascending
    sequences = 0

    def put(n: int, count: int, first: int, offset: int) -> None:
        runs.append((n, used[n], count, first, offset))
        used[n] += count
        left[n] -= count

    def leave(space: int, first: int, count: int) -> None:
        if space and count:
            if space not in gaps or not gaps[space]:
                gaps.setdefault(space, [])
                if (at := bisect_left(free, space)) == len(free) or free[at] != space:
                    insort(free, space)
            gaps[space].append([first, count])

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    partners = sorted(large)
    for n in large:
        while left[n] > 0:
            while (at := bisect_left(partners, capacity - n + 1)) and not left[partners[at - 1]]:
                partners.pop(at - 1)
            m = partners[at - 1] if at else 0
            if m == n and left[n] < 2:  # the last one of its length can't be its own partner
                m = next((x for x in reversed(partners[: at - 1]) if left[x]), 0)
            if not m:
                count = left[n]
                put(n, count, sequences, 0)
                leave(capacity - n, sequences, count)
            else:
                count = left[n] // 2 if m == n else min(left[n], left[m])
                put(n, count, sequences, 0)
                put(m, count, sequences, n)
                leave(capacity - n - m, sequences, count)
            sequences += count

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n] > 0:
            at = bisect_left(free, n)
            while at < len(free) and not gaps[free[at]]:
                gaps.pop(free.pop(at))
            if at == len(free):  # no gap: open sequences for all that are left, filled as they fit
                count = -(-left[n] // (capacity // n))
                gaps[capacity].append([sequences, count])
                insort(free, capacity)
                sequences += count
                continue
            space = free[at]
            first, count = gaps[space].pop()
            times = min(space // n, -(-left[n] // count))  # the tightest gap stays the tightest
            for k in range(times):
                some = min(count, left[n])
                put(n, some, first, capacity - space + k * n)
                if some < count:
                    leave(space - (k + 1) * n, first, some)
                    leave(space - k * n, first + some, count - some)
                    break
            else:
                leave(space - times * n, first, count)
    return runs


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start, length, ids (little-endian unsigned 32-bit)."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in encoded(batches, tokenizer, end_id):
            rows: list[tuple] = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                n = len(raw) // 4
                ends = range((n - 1) % capacity + 1, n + 1, capacity)
                start = 0
                for k, end in enumerate(ends):
                    rows.append((doc_id, k, start, end - start, raw[4 * start : 4 * end]))
                    start = end
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def pack(rows: DataFrame, keys: list[str], capacity: int) -> DataFrame:
    """rows with sequence_id and offset (in place of columns of these names); keys: columns that tell rows of one length apart."""
    rows = rows.drop("sequence_id", "offset")
    rank_name = unused(rows.columns, "_rank")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # capacity rows at most
    runs = sorted(pack_lengths(counts, capacity))
    table_ = np.array(runs, np.int64).reshape(len(runs), 5)
    step = 1 << 40  # more ranks than a length can have
    start = table_[:, 0] * step + table_[:, 1]
    placed = ranked(rows, ["length"], keys, rank_name)
    schema = placed.drop(rank_name).schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column(rank_name).to_numpy()
            run = np.searchsorted(start, length * step + rank, "right") - 1
            kept = batch.drop_columns([rank_name])
            found = [pa.array(table_[run, 3] + rank - table_[run, 1]), pa.array(table_[run, 4])]
            yield pa.RecordBatch.from_arrays([*kept.columns, *found], names=[*kept.schema.names, "sequence_id", "offset"])

    return placed.mapInArrow(place, schema)


def sequences(parts: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, offsets): the packed sequences themselves."""
    rows = parts.select("doc_id", "piece", "ids").join(placed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    ordered = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    packed = rows.groupBy("sequence_id").agg(ordered.alias("p"))
    return packed.select("sequence_id", F.expr("aggregate(p, X'', (a, x) -> a || x.ids)").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(pieces with ids, placed pieces without): the pieces are written once, to the shared folder."""
    parts = save(pieces(docs, tokenizer, end_id, capacity), "pieces")
    narrow = parts.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return parts, pack(narrow, ["doc_id", "piece", "start", "ids_crc32"], capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, placed = pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return placed


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as placed pieces (see op2_best_fit_packing)."""
    _, placed = pack_documents(docs, vocabulary("byte_bpe_50k.json"))
    return placed
