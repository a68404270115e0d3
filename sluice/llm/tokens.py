"""Token ids of whole texts, and files of them.

Encoder: the tokenizers library encodes each distinct piece of text once for a worker,
and a text's ids are the ids of its pieces. Pieces end where both vocabularies' patterns
always end a token: before a space that follows a non-space, between a letter and a sign,
around a lone line end. Texts where runs of white space could make such a cut wrong are
cut at the first kind of place only. So encoding by pieces equals encoding whole texts.

File format: Parquet with one row a document (doc_id, start_in_file, n_tokens, ids as a
list of ints), files and rows in ascending doc_id order. The ids' column is dictionary
encoded or, by choice, delta encoded (format v2); row groups and pages have set sizes
and Spark's writer adds page indexes, so a reader can take a doc_id range or the metadata
columns alone without touching other ids.

Defined results: a null text has no ids but the end id. A null doc_id sorts first.
Rows that repeat a doc_id stay, in no fixed order among themselves unless texts differ in
length. An empty table writes no rows. Extra columns are dropped.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import counted_at_most, scratch, slices, table, worker_cache

#: A place where every token ends, in any text: before a space that follows a non-space.
CUT = re.compile(r"(?<=\S)(?= )")
#: Others: between a letter and one of these signs, and around a lone line end after a sign.
LETTER = "([A-Za-zÀ-ÖØ-öø-ÿ])"
LETTER_SIGN, SIGN_ENDS = LETTER + "([.,!?;:])", (".\n", "!\n", "?\n", ",\n", ":\n")
MARK = "\1"
#: One word of Latin letters, with or without a space before it.
WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable bytes as they are, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Kept(dict):
    """A cache of two generations with about `limit` entries each."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older = limit, {}

    def missing(self, wanted: set[str]) -> list[str]:
        """Those of `wanted` that neither generation has; those of the older one are taken over."""
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()
        new, older = [], self.older
        for c in wanted.difference(self):
            if c in older:
                self[c] = older[c]
            else:
                new.append(c)
        return new


def pieces_of(texts: list[str]) -> list[list[str]]:
    """Each text cut into pieces that are encoded apart. All but the first begin where a token does.

    A lone space, or one before more white space, may stand at a wrong cut, since a run of
    white space is one token but for its last character; the encoder looks for those.
    """
    marked = pc.replace_substring_regex(pa.array(texts, pa.large_string()), LETTER_SIGN, "\\1" + MARK + "\\2")
    for end in SIGN_ENDS:
        marked = pc.replace_substring(marked, end, end[0] + MARK + "\n")
    marked = pc.replace_substring_regex(marked, MARK + "\n" + LETTER, MARK + "\n" + MARK + "\\1")
    marked = pc.replace_substring(marked, " ", MARK + " ")
    return [m.split(MARK) if MARK not in t else CUT.split(t) for m, t in zip(marked.to_pylist(), texts, strict=True)]


class Encoder:
    """text -> ids as little-endian unsigned 32-bit integers, in bytes.

    Pieces seen before come from a cache. New ones that are plain words go to the
    tokenizer's model at once; for them the steps before it only change case and drop or
    keep the space. Others are encoded many at a time with a special token between them,
    whose id then parts the ids; the tokenizer treats what lies between special tokens apart.
    """

    def __init__(self, path: str, limit: int = 500_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.mark_id, self.mark = min((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items())
        self.danger = self.mark[0]
        self.pieces = Kept(limit)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        # How this tokenizer treats a plain word, or None where neither way gives its ids.
        probe = ["a", " The", "Straße", " éÀ", "Ünterwords", " zzxqj"]
        ways = [(lower, space) for lower in (False, True) for space in (True, False)]
        self.way = next((w for w in ways if self._words(probe, *w) == [self._alone(p) for p in probe]), None)

    def _words(self, words: list[str], lower: bool, space: bool) -> list[bytes]:
        """Plain words, with or without a space before them, through the model alone."""
        text = "\n".join(words)
        text = text if space else text.replace(" ", "")
        mapped = (text.lower() if lower else text).encode().decode("latin1").translate(self.letters)
        tokenize = self.model.tokenize
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in mapped.split(self.letters[10])]

    def _alone(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, pieces: list[str], group: int = 4000) -> list[bytes]:
        """pieces: without the first character of special tokens."""
        out: list[bytes] = []
        for at in range(0, len(pieces), group):
            joined = self.mark.join(pieces[at : at + group])
            ids = np.asarray(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            raw, last = ids.tobytes(), 0
            for cut in (np.flatnonzero(ids == self.mark_id) * 4).tolist():
                out.append(raw[last:cut])
                last = cut + 4
            out.append(raw[last:])
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Encode the pieces that no text had before."""
        new = self.pieces.missing(pieces)
        words, other = [], new
        if self.way:
            lower, space = self.way
            words = [p for p in new if WORD.fullmatch(p)]
            if lower:
                words = [p for p in words if p.isascii() or p.lower().strip(" ").isalpha()]
            if words:
                self.pieces.update(zip(words, self._words(words, lower, space), strict=True))
                other = set(new).difference(words)
        plain = []
        for p in other:
            if p[:1] == " " and (p == " " or p[1].isspace()):
                self.pieces[p] = None  # next to more white space, so the cut before it may be wrong
            elif self.danger in p:
                self.pieces[p] = self._alone(p)  # may hold a special token
            else:
                plain.append(p)
        if plain:
            self.pieces.update(zip(plain, self._ids(plain), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        lists = pieces_of(texts)
        self._learn(set(chain.from_iterable(lists)))
        get, join, out = self.pieces.__getitem__, b"".join, []
        for text, parts in zip(texts, lists, strict=True):
            try:
                out.append(join(map(get, parts)))
            except TypeError:  # a piece that has None for its ids
                out.append(join(map(self._alone, CUT.split(text))))
        return out


def encoder_of(path: str) -> Encoder:
    """The encoder of a vocabulary, kept in this worker from task to task."""
    return worker_cache(f"encoder {path}", lambda: Encoder(path))


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch, cut to a few MB, with its texts' ids and the end id."""
    encoder, end = encoder_of(path), np.asarray([end_id], "<u4").tobytes()
    for batch in slices(batches, "text", 3 << 20):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        yield batch, [x + end for x in encoder.encode(texts)]


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, encoding: str = "dictionary", row_group_mb: int = 16, page_kb: int = 256) -> None:
    """Encode docs (doc_id, text) and write the ids as files under path, in doc_id order."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start_in_file", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    arrow = pa.schema([("doc_id", pa.int64()), ("start_in_file", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.field("element", pa.int32(), nullable=False)))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch, ids in encoded(batches, tokenizer, end_id):
            n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            stop = np.cumsum(n)
            values = pa.py_buffer(b"".join(ids))
            lists = pa.ListArray.from_buffers(
                arrow.field("ids").type, len(ids), [None, pa.py_buffer(np.concatenate(([0], stop)).astype(np.int32).tobytes())],
                children=[pa.Array.from_buffers(pa.int32(), int(stop[-1]), [None, values])],
            )
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(at + stop - n), pa.array(n), lists], schema=arrow)
            at += int(stop[-1])

    # A file for each range of doc_ids; Spark's sampling sizes the ranges alike. Rows that share a doc_id, or have none, may be cut too.
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumns({"size": F.length("text"), "at": F.monotonically_increasing_id()})
    parts = rows.repartitionByRange("doc_id", "size", "at").sortWithinPartitions("doc_id", "size", "at").drop("size", "at")
    writer = parts.mapInArrow(encode, schema).write.option("compression", "zstd").option("parquet.block.size", row_group_mb << 20).option("parquet.page.size", page_kb << 10)
    if encoding == "delta":
        writer = writer.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false")
    else:
        writer = writer.option("parquet.enable.dictionary", "true").option("parquet.dictionary.page.size", 1 << 20)
    writer.parquet(path)


def _small(files: DataFrame, bound: int = 50_000) -> DataFrame:
    """files, a row for each file, to be broadcast if they are few enough (some 5 MB)."""
    return F.broadcast(files) if counted_at_most(files, bound) else files


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc_id, start, n_tokens) of each document, read from the metadata columns alone.

    Files follow each other by their smallest doc_id; where a doc_id spans files, by name.
    The window runs over one row a file.
    """
    rows = spark.read.parquet(path).select("doc_id", "start_in_file", "n_tokens", F.col("_metadata.file_name").alias("file"))
    files = rows.groupBy("file").agg(F.min("doc_id").alias("least"), F.sum("n_tokens").alias("n"))
    first = files.select("file", (F.sum("n").over(W.orderBy(F.col("least").asc_nulls_first(), "file")) - F.col("n")).alias("first"))
    return rows.join(_small(first), "file").select("file", "doc_id", (F.col("start_in_file") + F.col("first")).alias("start"), "n_tokens", "start_in_file")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id, start_in_file, n_tokens, ids, file of the documents with low <= doc_id < high; other pages are skipped."""
    rows = spark.read.parquet(path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") < high)
    return rows.select("*", F.col("_metadata.file_name").alias("file"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), 2)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("doc_id"), batch.column("start_in_file"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["file", "doc_id", "start_in_file", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("file", "doc_id", "start_in_file", "ids").mapInArrow(digests, "file string, doc_id long, start_in_file long, n_tokens long, ids_crc32 long")
    index = token_index(spark, path)
    first = index.groupBy("file").agg(F.min(F.col("start") - F.col("start_in_file")).alias("first"))
    return rows.join(_small(first), "file").select("doc_id", (F.col("start_in_file") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
