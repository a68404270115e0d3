import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from sluice.llm import packing, tokens

from .helpers import DOCS, odd_documents, write


def truth(name, rows, end=2):
    t = Tokenizer.from_file(tokens.vocabulary(name))
    return [[*t.encode(text or "", add_special_tokens=False).ids, end] for _, text, *_ in rows]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def documents(spark, small):
    return [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_encode_as_whole_texts(name):
    rng = random.Random(7)
    alphabet = " \n\n\t.,!?|;'×÷ab1éİSßÀ́<|>s \x1c"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a <|endoftext|> b", "a\0 b", "  ", "", "We'll don't  'S"]
    encoder = tokens.Encoder(tokens.vocabulary(name), limit=200)
    got = [np.frombuffer(x, "<u4").tolist() for k in range(0, len(texts), 97) for x in encoder.encode(texts[k : k + 97])]
    plain = Tokenizer.from_file(tokens.vocabulary(name))
    assert got == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_read_back(spark, tmp_path, encoding):
    rows = odd_documents()
    frame = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"lang": "ids", "source": "start"})
    path = str(tmp_path / "t")
    tokens.write_tokens(frame, path, tokens.vocabulary("word_bpe_49k.json"), 2, encoding)
    got = sorted((r["doc_id"] is not None, r["doc_id"], list(r["ids"])) for r in tokens.read_tokens(spark, path).collect() if r["doc_id"] is not None)
    want = sorted((True, r[0], ids) for r, ids in zip(rows, truth("word_bpe_49k.json", rows), strict=True) if r[0] is not None)
    assert got == want
    assert sorted(r["doc_id"] for r in tokens.read_tokens(spark, path, 3, 6).collect()) == [3, 3, 4, 5]
    index = sorted((r["start"], r["n_tokens"]) for r in tokens.token_index(spark, path).collect())
    at = 0
    for start, n in index:
        assert start == at
        at += n


def test_op3_equals_whole_encoding(spark, small):
    rows = documents(spark, small)
    want, at = [], 0
    for row, ids in zip(rows, truth("word_bpe_49k.json", rows), strict=True):
        want.append((row[0], at, len(ids), crc(ids)))
        at += len(ids)
    got = sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in tokens.op3_token_files(spark, small).collect())
    assert got == want


def check_packing(rows, result, capacity):
    want = defaultdict(int)
    for row, ids in zip(rows, truth("byte_bpe_50k.json", rows), strict=True):
        first = (len(ids) - 1) % capacity + 1
        ends = range(first, len(ids) + 1, capacity)
        for k, end in enumerate(ends):
            start = 0 if k == 0 else end - capacity
            want[row[0], k, start, end - start, crc(ids[start:end])] += 1
    got, bins = defaultdict(int), defaultdict(list)
    for r in result:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_op2_on_small_documents(spark, small):
    rows = documents(spark, small)
    bins = check_packing(rows, packing.op2_best_fit_packing(spark, small).collect(), 1024)
    total = sum(n for parts in bins.values() for _, n in parts)
    assert len(bins) <= -(-total // 1024) * 1.02 + 1


def test_op2_on_odd_documents(spark, tmp_path):
    rows = odd_documents()
    check_packing(rows, packing.op2_best_fit_packing(spark, write(spark, tmp_path, rows)).collect(), 1024)
    empty = tmp_path / "empty"
    assert packing.op2_best_fit_packing(spark, write(spark, empty, [])).count() == 0
    assert tokens.op3_token_files(spark, str(empty)).count() == 0


def test_sequences_hold_the_pieces(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    parts, placed = packing.pack_documents(docs, tokens.vocabulary("byte_bpe_50k.json"), capacity=256)
    ids = {(r["doc_id"], r["piece"]): r["ids"] for r in parts.collect()}
    at = {(r["doc_id"], r["piece"]): (r["sequence_id"], r["offset"]) for r in placed.collect()}
    packed = {r["sequence_id"]: r["ids"] for r in packing.sequences(parts, placed).collect()}
    for key, raw in ids.items():
        seq, offset = at[key]
        assert packed[seq][4 * offset : 4 * offset + len(raw)] == raw


@pytest.mark.parametrize("seed", range(30))
def test_runs_place_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 7, 10, 64])
    counts = defaultdict(int)
    for _ in range(rng.choice([0, 1, 5, 200])):
        counts[rng.randint(1, capacity)] += 1
    bins, ranks = defaultdict(list), defaultdict(list)
    for n, rank, count, first, offset in packing.pack_lengths(dict(counts), capacity):
        ranks[n] += range(rank, rank + count)
        for k in range(count):
            bins[first + k].append((offset, n))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    assert sorted(bins) == list(range(len(bins)))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity and sum(3 * n > capacity for _, n in parts) <= 2


def test_pack_keeps_clashing_columns(spark):
    rows = spark.createDataFrame([(k, 0, 1 + k % 5, "a", "b", "c") for k in range(50)], "doc_id long, piece int, length long, _rank string, _bucket string, sequence_id string")
    placed = packing.pack(rows, ["doc_id", "piece"], 8)
    assert placed.columns == ["doc_id", "piece", "length", "_rank", "_bucket", "sequence_id", "offset"]
    assert {(r["_rank"], r["_bucket"]) for r in placed.collect()} == {("a", "b")} and placed.schema["sequence_id"].dataType.typeName() == "long"


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_have_the_layout_asked_for(spark, small, tmp_path, encoding):
    """Encodings, row groups of a set size, and page indexes, read off the files; a hot doc_id spans files."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    hot = docs.unionByName(spark.range(3000).selectExpr("7L AS doc_id", "concat('the same id, text ', id) AS text")).unionByName(spark.range(50).selectExpr("CAST(NULL AS LONG) AS doc_id", "'no id' AS text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokens.write_tokens(hot, f"{tmp_path}/t", tokens.vocabulary("word_bpe_49k.json"), 2, encoding, row_group_mb=1, page_kb=8)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "t").glob("part-*.parquet"))
    index = tokens.token_index(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert len(index) == hot.count() and len({r["file"] for r in index if r["doc_id"] == 7}) > 1
    at = 0
    for r in index:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in index]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    for f in files:
        meta = pq.read_metadata(f)
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            column = next(v for k, v in columns.items() if k.startswith("ids"))
            wanted = {"RLE_DICTIONARY", "PLAIN_DICTIONARY"} if encoding == "dictionary" else {"DELTA_BINARY_PACKED"}
            assert wanted & set(column.encodings) and column.has_offset_index and column.compression == "ZSTD"
