"""Quality classifier from weak labels: EM over heuristic labellers, then a hashed linear scorer.

1. Each document gets the votes of overlapping labellers: good, bad or none.
2. The corpus comes down to counts of vote patterns (3 to the number of labellers at
   most), counted over all documents. EM on these counts estimates how often each
   labeller votes what on good and on bad documents (two-coin model with Dirichlet
   priors that say which side a labeller is meant for, so that classes can't swap).
3. The posterior of its pattern is a document's soft label. A bounded sample
   (`sample_rows` rows at most, by a hash of doc_id and text, half of each side) trains a
   logistic scorer on hashed features: word shapes, pairs of shapes and binned shares. All
   other steps cover all documents.
4. Every document is scored on its whole text; below `threshold` it is rejected.

Texts are read once: the first pass writes each document's votes and features (counts of
hashed shapes), and the scorer reads those. Nothing is shuffled but pattern counts and the
sample, so no key can be hot. The driver sees pattern counts and the sample's features.

Defined results: a null, empty or blank text has no words, votes bad and is scored on
that. Repeated rows are scored alike and sampled once; a null doc_id is a value like others.
On an empty table, or where the sample has one side only, the model is the labellers' prior:
the scorer then is a constant and nothing is rejected. Extra columns are kept by `stage`,
whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_of, save, slices, table, tables_made, text_hash, unused, window_hashes, without, worker_cache

DIM = 1 << 16
SAMPLE_ROWS = 20_000
SHARES = ("plain", "capital", "separator", "adjacent", "window", "dup_lines", "sentence")
#: A labeller: its name, the share it reads, and the bounds at which it votes bad or good (None: never).
LABELLERS = (
    ("odd_words", "plain", ("<", 0.6), None),
    ("plain_words", "plain", None, (">", 0.9)),
    ("shouting", "capital", (">", 0.5), None),
    ("menus", "separator", (">", 0.15), None),
    ("stutter", "adjacent", (">", 0.2), ("<", 0.02)),
    ("loops", "window", (">", 0.25), None),
    ("copied_lines", "dup_lines", (">", 0.3), None),
    ("sentences", "sentence", ("<", 0.15), (">", 0.6)),
)
PLAIN = re.compile(r"[\"'(«¿¡]?\w+(?:['’-]\w+)*[.,;:!?)»\"']{0,2}")
SHAPES = (re.compile(r"[^\W\d_]*[a-zà-öø-ÿ][^\W\d_]*"), re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1{2,}"))


def shapes_of(word: str) -> list[str]:
    """A word with runs of letters as a or A, of digits as 0, and long runs of a sign as three; a long word is many, which cover it."""
    out = []
    for k in range(0, len(word), 64):
        shape = SHAPES[0].sub("a", word[k : k + 64])
        shape = SHAPES[2].sub("0", re.sub(r"[A-ZÀ-ÖØ-Þ]+", "A", shape))
        shape = SHAPES[3].sub(r"\1\1\1", shape)
        out += [shape[i : i + 12] for i in range(0, len(shape), 12)]
    return out


SMALL = re.compile("[a-zà-öø-ÿ]")
#: Words of letters, a small Latin one among them, and at most one sign after them: their only shape.
USUAL = {tail: zlib.crc32(f"a{tail}".encode()) for tail in ("", *".,;:!?")}


class Shapes(dict):
    """Ids of words, and tables by id: hash, flags, and where a word's shapes stand in `shape`.

    Flags: plain 1, all capitals 2, a separator 4, an end of a sentence 8, a capital first 16.
    """

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit
        self.make_room()

    def __missing__(self, word: bytes) -> int:
        hashes, flags, starts, counts, shape = self.new
        text = word.decode("utf-8", "replace")
        tail = text[-1] if text[-1] in ".,;:!?" else ""
        core = text[:-1] if tail else text
        if core.isalpha() and len(core) < 64 and (not core.isupper() if core.isascii() else SMALL.search(core)):
            flags.append(1 | (tail in (".", "!", "?")) << 3 | core[0].isupper() << 4)
            found = [USUAL[tail]]
        else:
            flags.append((PLAIN.fullmatch(text) is not None) | (text.isupper() and len(text) > 1) << 1 | any(c in "|»·" for c in text) << 2 | (text[-1] in ".!?…") << 3 | text[0].isupper() << 4)
            found = [zlib.crc32(x.encode()) for x in shapes_of(text)]
        hashes.append(xxhash.xxh64_intdigest(word))
        starts.append(len(self.held[4]) + len(shape))
        counts.append(len(found))
        shape.extend(found)
        value = self[word] = len(self)
        return value

    def make_room(self) -> None:
        """Between batches: start anew when the words' shapes are too many."""
        if not self or len(self.held[4]) > self.limit:
            self.clear()
            self.held = [np.empty(0, k) for k in (np.uint64, np.uint8, np.int64, np.int64, np.int64)]
            self.new: tuple[list, ...] = ([], [], [], [], [])

    def tables(self) -> list[np.ndarray]:
        if self.new[0]:
            self.held = [np.concatenate((old, np.array(x, old.dtype))) for old, x in zip(self.held, self.new, strict=True)]
            self.new = ([], [], [], [], [])
        return self.held


@dataclass
class Batch:
    """What is read off a batch of texts: columns by text, and features as lists (at: offsets)."""

    shares: dict[str, np.ndarray]
    n_words: np.ndarray
    n_shapes: np.ndarray
    at: np.ndarray
    index: np.ndarray
    count: np.ndarray

    def patterns(self) -> list[str]:
        """A letter for each labeller: g, b or - for none."""
        out = np.full((len(self.n_words), len(LABELLERS)), ord("-"), np.uint8)
        holds = lambda rule, x: x < rule[1] if rule[0] == "<" else x > rule[1]
        for j, (_, share, bad, good) in enumerate(LABELLERS):
            for rule, letter in ((good, "g"), (bad, "b")):
                if rule:
                    out[holds(rule, self.shares[share]), j] = ord(letter)
        out[self.n_words == 0] = ord("b")
        return out.view(f"S{len(LABELLERS)}").ravel().astype(str).tolist()

    def bins(self) -> np.ndarray:
        """The tenth that each share is in, a row of len(SHARES) bytes for each text."""
        return np.stack([np.minimum(9, (self.shares[k] * 10).astype(np.int64)).astype(np.uint8) for k in SHARES], axis=1)


def bin_features() -> np.ndarray:
    """The feature of each share and tenth."""
    return np.array([[zlib.crc32(f"{k}={b}".encode()) % DIM for b in range(10)] for k in SHARES], np.int64)


def _by_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def _offsets(counts) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int64)


def read_batch(texts: list[bytes | None], known: Shapes) -> Batch:
    """Shares and hashed features of whole texts, all texts of a batch at once."""
    known.make_room()
    tokens: list[bytes] = []
    sizes, widths, n_lines, distinct = [], [], [], []
    for text in texts:
        lines, before = [], len(tokens)
        for line in (text or b"").split(b"\n"):
            if ws := line.split():
                lines.append(line)
                tokens += ws
                widths.append(len(ws))
        sizes.append(len(tokens) - before)
        n_lines.append(len(lines))
        distinct.append(len(set(lines)))
    n, docs = np.array(sizes, np.int64), len(texts)
    at, total = _offsets(sizes), len(tokens)
    ids = np.fromiter(map(known.__getitem__, tokens), np.int64, total)
    del tokens
    hashes, flags, starts, counts, shape = known.tables()
    doc = np.repeat(np.arange(docs), n)
    flag = flags[ids] if total else np.empty(0, np.uint8)
    per_word = np.maximum(n, 1)

    inside = doc[1:] == doc[:-1]
    again = np.concatenate(((ids[1:] == ids[:-1]) & inside, [False]))[:total]
    windows = window_hashes(hashes[ids] if total else np.empty(0, np.uint64), (0, 1, 2, 3, 4))
    own = doc[: len(windows)] == doc[4 : 4 + len(windows)]
    low = np.uint64(max(1, docs - 1).bit_length())
    keys = np.sort((doc[: len(windows)][own].astype(np.uint64) << (np.uint64(64) - low)) | (windows[own] >> low))
    first = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    n_windows = np.maximum(n - 4, 0)
    loops = 1 - np.bincount((first >> (np.uint64(64) - low)).astype(np.int64), minlength=docs) / np.maximum(n_windows, 1)
    line_at = _offsets(widths)
    good_line = (flag[line_at[:-1]] & 17 == 17) & (flag[line_at[1:] - 1] & 8 > 0) if total else np.empty(0, bool)
    lines_at, per_line = _offsets(n_lines), np.maximum(n_lines, 1)
    shares = {
        "plain": _by_text(flag & 1, at) / per_word, "capital": _by_text(flag >> 1 & 1, at) / per_word, "separator": _by_text(flag >> 2 & 1, at) / per_word,
        "adjacent": _by_text(again, at) / per_word, "window": np.where(n_windows > 0, loops, 0.0),
        "dup_lines": np.where(n > 0, 1 - np.array(distinct) / per_line, 0.0), "sentence": _by_text(good_line, lines_at) / per_line,
    }

    each = counts[ids] if total else np.empty(0, np.int64)
    shape_at = _offsets(each)
    places = np.repeat(starts[ids] - shape_at[:-1], each) + np.arange(shape_at[-1]) if total else np.empty(0, np.int64)
    of, shape = np.repeat(doc, each), shape[places]
    pair = of[1:] == of[:-1]
    features = np.concatenate((of * DIM + shape % DIM, of[1:][pair] * DIM + (shape[:-1][pair] * 31 + shape[1:][pair] * 17 + 7) % DIM))
    features = np.sort(features.astype(np.int32) if docs * DIM < 1 << 31 else features)
    new = np.flatnonzero(np.concatenate(([True], features[1:] != features[:-1]))) if len(features) else np.empty(0, np.int64)
    found = features[new].astype(np.int64)
    return Batch(shares, n, np.bincount(of, minlength=docs), _offsets(np.bincount(found // DIM, minlength=docs)), found % DIM, np.diff(np.append(new, len(features))))


FEATURES = "pattern string, pick long, n_shapes long, bins binary, index array<int>, count array<int>"


def _columns(texts: list[bytes | None], ids: list[int | None], known: Shapes) -> pa.StructArray:
    """FEATURES of a batch."""
    b = read_batch(texts, known)
    at = pa.array(b.at.astype(np.int32))
    picks = [xxhash.xxh64_intdigest(t or b"", 0 if d is None else d % (1 << 64)) >> 1 for t, d in zip(texts, ids, strict=True)]
    lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (b.index, b.count)]
    bins = b.bins()
    columns = [pa.array(b.patterns(), pa.string()), pa.array(picks, pa.int64()), pa.array(b.n_shapes.astype(np.int64)), pa.array([r.tobytes() for r in bins], pa.binary()), *lists]
    return pa.StructArray.from_arrays(columns, names=["pattern", "pick", "n_shapes", "bins", "index", "count"])


def with_features(docs: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, and FEATURES in a column `name`."""
    passed = docs.select(*keep)
    source = docs.select(*keep, F.struct(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text")).alias(unused(keep, "_source")))
    schema = T.StructType([*passed.schema.fields, T.StructField(name, T.StructType.fromDDL(FEATURES))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cache("shapes", Shapes)
        for batch in slices(batches, -1):
            ids, texts = batch.columns[-1].flatten()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _columns(texts.cast(pa.binary()).to_pylist(), ids.to_pylist(), known)], names=[*batch.schema.names[:-1], name])

    return source.mapInArrow(scan, schema)


@dataclass
class Votes:
    """What EM found: the share of good documents and P(vote | side) of each labeller."""

    good: float
    chances: np.ndarray  # labeller, side (bad, good), vote (b, g, -)

    def posterior(self, pattern: str) -> float:
        """P(good | pattern)."""
        at = ["bg-".index(c) for c in pattern]
        log = np.log([1 - self.good, self.good]) + sum(np.log(self.chances[j, :, v]) for j, v in enumerate(at))
        return float(1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50))))


def expectation_maximisation(counts: dict[str, int], rounds: int = 100, strength: float = 0.02) -> Votes:
    """Fit the two-coin model to counts of vote patterns.

    strength: the weight of the priors as a share of all documents.
    """
    patterns, n = list(counts), np.array(list(counts.values()), float)
    total, m = max(1.0, n.sum()), len(LABELLERS)
    one_hot = np.zeros((len(patterns), m, 3))
    for i, p in enumerate(patterns):
        for j, c in enumerate(p):
            one_hot[i, j, "bg-".index(c)] = 1
    prior = np.empty((m, 2, 3))
    for j, (_, _, bad, good) in enumerate(LABELLERS):
        prior[j, 0] = (0.4 if bad else 0.001, 0.05 if good else 0.001, 0.6)
        prior[j, 1] = (0.01 if bad else 0.001, 0.6 if good else 0.001, 0.9)
    prior /= prior.sum(axis=2, keepdims=True)
    model = Votes(0.85, prior)
    for _ in range(rounds):
        post = np.array([model.posterior(p) for p in patterns]) if patterns else np.empty(0)
        weight = np.stack((n * (1 - post), n * post), axis=1)
        seen = np.einsum("is,ijv->jsv", weight, one_hot) + prior * (strength * total + 1)
        chances = seen / seen.sum(axis=2, keepdims=True)
        good = (weight[:, 1].sum() + 0.85 * strength * total + 0.85) / (total * (1 + strength) + 1)
        done = abs(good - model.good) < 1e-7 and np.abs(chances - model.chances).max() < 1e-6
        model = Votes(float(np.clip(good, 0.01, 0.99)), chances)
        if done:
            break
    return model


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 150, l2: float = 1e-5) -> np.ndarray:
    """Weights (the last one is the constant) of a logistic scorer for soft labels, both sides weighing the same."""
    w = np.zeros(DIM + 1)
    y = np.array([r[2] for r in rows])
    if not len(rows) or not (y < 0.5).any() or not (y >= 0.5).any():
        w[-1] = 5.0
        return w
    at = np.concatenate([r[0] for r in rows])
    x = np.concatenate([r[1] for r in rows]).astype(float)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    each = np.where(y < 0.5, 0.5 / (y < 0.5).sum(), 0.5 / (y >= 0.5).sum())
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[at], len(rows)) + w[-1], -30, 30)))
        d = (p - y) * each
        g = np.append(np.bincount(at, x * d[row], DIM) + l2 * w[:-1], d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(features: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Votes, np.ndarray]:
    """(label model, scorer's weights) for features, a saved table with the fields of FEATURES as columns."""
    spark = features.sparkSession
    counts = {r["pattern"]: r["count"] for r in features.groupBy("pattern").count().collect()}  # at most 3 ** labellers rows
    model = expectation_maximisation(counts)
    label = {p: model.posterior(p) for p in counts}
    plan, each = [], sample_rows // 2
    for good in (False, True):
        n = sum(c for p, c in counts.items() if (label[p] >= 0.5) == good)
        # Twice the wanted share is drawn by a hash, and the least hashes of these are taken.
        plan += [(p, float(y), good, int(min(1.0, 2 * each / max(1, n)) * 1_000_000)) for p, y in label.items() if (y >= 0.5) == good]
    plan = spark.createDataFrame(plan, "pattern string, label double, good boolean, chance long")
    drawn = features.join(F.broadcast(plan), "pattern").where(F.pmod("pick", F.lit(1_000_000)) < F.col("chance"))
    drawn = drawn.select("good", "label", "pick", "n_shapes", "bins", "index", "count").dropDuplicates(["pick"])
    bins, found = bin_features(), []
    for good in (False, True):
        rows = drawn.where(F.col("good") == good).orderBy(F.xxhash64("pick"), "pick").limit(each).select("label", "n_shapes", "bins", "index", "count").toArrow()
        for batch in rows.to_batches():
            columns = (batch.column(c) for c in ("label", "n_shapes", "bins", "index", "count"))
            for y, n, tenths, index, count in zip(*columns, strict=True):
                own = bins[np.arange(len(SHARES)), np.frombuffer(tenths.as_py(), np.uint8)]
                at = np.concatenate((index.values.to_numpy().astype(np.int64), own))
                found.append((at, np.concatenate((count.values.to_numpy() / max(1, n.as_py()), np.full(len(SHARES), 0.3))).astype(np.float32), y.as_py()))
    return model, train(found)


def with_scores(rows: DataFrame, features: str, weights: np.ndarray, name: str) -> DataFrame:
    """rows with the scorer's P(good) in a column `name` instead of their column `features`."""
    held = rows.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([*rows.drop(features).schema.fields, T.StructField(name, T.DoubleType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bins = held.value, bin_features()
        for batch in batches:
            if not batch.num_rows:
                continue
            found = dict(zip(("pattern", "pick", "n_shapes", "bins", "index", "count"), batch.column(features).flatten(), strict=True))
            index, count = (found[k].flatten().to_numpy(zero_copy_only=False) for k in ("index", "count"))
            at = _offsets(np.diff(found["index"].offsets.to_numpy()))
            sums = np.concatenate(([0.0], np.cumsum(w[index] * count)))
            tenths = np.frombuffer(b"".join(found["bins"].to_pylist()), np.uint8).reshape(-1, len(SHARES))
            total = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(1, found["n_shapes"].to_numpy()) + 0.3 * w[bins[np.arange(len(SHARES)), tenths]].sum(axis=1) + w[-1]
            rest = batch.drop_columns([features])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], names=[*rest.schema.names, name])

    return rows.mapInArrow(scan, schema)


def fitted_scores(docs: DataFrame, name: str, keep: list[str], sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The columns `keep` of docs (doc_id, text, ...) and P(good), by a scorer fitted on these documents, in a column `name`."""
    features = unused([*keep, name], "_features")
    rows = save(with_features(docs, features, keep), "features")
    _, weights = fit(rows.select(f"{features}.*"), sample_rows)
    return with_scores(rows, features, weights, name)


def op7_quality_classifier(spark: SparkSession, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    rows = fitted_scores(table(spark, sf_dir, "documents"), "p_good", ["doc_id"])
    return rows.select("doc_id", F.round("p_good", 4).alias("p_good"), (F.col("p_good") >= threshold).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """The documents that the scorer, fitted on these documents, takes for good. Of what is made on the way only the rejected rows' ids stay."""
    with tables_made() as made:
        scored = fitted_scores(docs.select("doc_id", "text", text_hash().alias("h")), "p", ["doc_id", "h"])
        gone = save(scored.where(F.col("p") < threshold).select("doc_id", "h").distinct(), "gone")
    kept_of(made, gone)
    return without(docs, gone)
