"""Jaccard join of word shingles by grouped prefixes, exact, down to components.

1. Every text becomes its set of 64-bit shingle hashes. Equal sets (by a 128-bit digest) are
   one class with a number of its own, whatever doc_ids its rows have, so exact copies
   cost a row each and no pair, and texts that share a doc_id are told apart.
2. A total order of shingles puts the most frequent ones last (counted over all
   documents); the hash breaks ties. The first n - ceil(t n) + 1 shingles of a set in
   that order are its prefix: sets that link share a shingle of their prefixes.
3. Classes with equal prefix and size are one group. Groups that share a prefix shingle
   form a bucket. Round 1 is linear: each group of a bucket meets the bucket's most
   central group and one taken by hash. Pairs pass the size filter and a filter on
   parity maps (the maps of two sets differ in at most as many bits as the sets
   in shingles, so no link is lost), are expanded to members and verified on whole sets.
4. Round 2 is what makes it exact: buckets that round 1 left in more than one component
   are compared group by group, in blocks of bounded size spread over tasks. A pair of
   groups leaves its task only if it is not connected already and passes the size and map
   filters; then its prefixes must share enough shingles. Groups of several members are
   expanded in the same way: only members of different components meet, in blocks. So large
   groups of near copies, which round 1 connects, never cost their square in rows, and
   nothing is capped or dropped.

Only pairs that pass the filters leave a task. The driver sees counts and at most
HOT_SHINGLES frequent shingles; the order may be any, so that bound cuts no result.

Defined results: a null, empty or blank text has an empty set and links with nothing. A
text with fewer than k words is one shingle, the whole sequence. A null doc_id links
with nothing and has a null component. Rows are judged each by its own text, whether they
repeat or share a doc_id with other texts: a row's component_id is the least doc_id that its text
reaches. An empty table gives no rows. Extra columns are dropped. `stage` keeps one row of each
component, the least by doc_id, then text hash; of rows equal in doc_id and text, a null doc_id included,
one; and rows without a word, or without a doc_id, otherwise as they are.

Everything written on the way is deleted before the result is given, which is a table of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, counted_at_most, discard, kept_of, save, slices, table, tables_made, text_hash, window_hashes, without, worker_cache
from .components import components

#: Shingles in more prefixes than this are put last; at most so many are.
HOT_COUNT, HOT_SHINGLES = 32, 200_000
#: Members of a bucket's block in round 2.
BLOCK = 1024
#: Candidate ids up to this many are broadcast to the scan of the texts; more are joined by a shuffle.
BROADCAST_IDS = 400_000
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The least size of a parity map.
MAP_BITS = 512
#: The sizes to which round 2 folds larger ones: in buckets of FEW groups at most, where a row has few pairs, and in others.
FEW, FOLD_BYTES, MAP_BYTES = 16, 16, 256
#: So many shingles of large buckets go with a row, so that a pair leaves one of its buckets only.
HEADS = 16
#: As `shared`: a pair seen in a large bucket, where it is not counted.
UNCOUNTED = 1 << 40


def shingle_set(text: bytes | None, words: WordHashes, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text (UTF-8), letters A-Z folded."""
    tokens = (text or b"").translate(FOLD).split()  # splits at \x20 and \x09 to \x0D
    if len(tokens) >= k:
        return np.unique(window_hashes(words.of(tokens), tuple(range(k))))
    if not tokens:
        return np.empty(0, np.uint64)
    return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), 1)], np.uint64)


def prefix_sizes(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.where(n > 0, n - (-(-num * n // den)) + 1, 0)


def parity_map(shingles: np.ndarray) -> bytes:
    """A bit for the parity of the shingles that fall on it: a power of two of bits, 512 or as many as shingles at least."""
    size = max(MAP_BITS, 1 << (len(shingles) - 1).bit_length() if len(shingles) else 0)
    bits = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(parity: bytes, size: int) -> bytes:
    """The same map in `size` bytes: what falls together cancels out."""
    if len(parity) == size:
        return parity
    return np.bitwise_xor.reduce(np.frombuffer(parity, np.uint8).reshape(-1, size), axis=0).tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """In how many bits two maps differ, in the size of the smaller one."""
    size = min(len(a), len(b))
    return (int.from_bytes(folded(a, size), "little") ^ int.from_bytes(folded(b, size), "little")).bit_count()


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    words = worker_cache("word hashes", WordHashes)
    for batch in slices(batches, "text"):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        yield batch, [shingle_set(t, words, k) for t in texts]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    at = np.cumsum([0, *(len(a) for a in arrays)]).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values))


def scan_sets(docs: DataFrame, k: int, num: int, den: int, hot: np.ndarray | None = None, with_maps: bool = True) -> DataFrame:
    """(doc_id, h, n, key, prefix, map, fold, heat) of each document; h: the text's hash, key: the set's digest, fold: the map in FOLD_BYTES bytes.

    hot: sorted hashes of the shingles that come last. heat: their share of the set in millionths.
    """
    held = docs.sparkSession.sparkContext.broadcast(np.sort(hot.astype(np.uint64)) if hot is not None else np.empty(0, np.uint64))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = held.value
        for batch, sets in _sets(batches, k):
            prefixes, maps, heat = [], [], []
            for s in sets:
                p = len(s) - (-(-num * len(s) // den)) + 1 if len(s) else 0
                if len(last) and len(s):
                    at = np.searchsorted(last, s)
                    is_last = last[np.minimum(at, len(last) - 1)] == s
                    heat.append(int(is_last.sum()) * 1_000_000 // len(s))
                    s_order = np.concatenate((s[~is_last], s[is_last]))
                else:
                    heat.append(0)
                    s_order = s
                prefixes.append(s_order[:p])
                maps.append(parity_map(s) if with_maps else None)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), _lists(prefixes), pa.array(maps, pa.binary()), pa.array([m and folded(m, FOLD_BYTES) for m in maps], pa.binary()), pa.array(heat, pa.int32())],
                names=["doc_id", "h", "n", "key", "prefix", "map", "fold", "heat"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text", text_hash().alias("h")).mapInArrow(scan, "doc_id long, h long, n long, key binary, prefix array<long>, map binary, fold binary, heat int")


def _linkable(a: str, b: str, num: int, den: int):
    """The size filter."""
    return (F.least(a, b) * den) >= (F.greatest(a, b) * num)


def filter_by_maps(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """pairs with na, nb, map_a, map_b (null: unknown) whose sets may link."""
    schema = pairs.drop("map_a", "map_b").schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = [batch.column(c).to_pylist() for c in ("map_a", "map_b", "na", "nb")]
            ok = [x is None or y is None or bits_apart(x, y) * (den + num) <= (den - num) * (m + n) for x, y, m, n in zip(*col, strict=True)]
            yield batch.drop_columns(["map_a", "map_b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(keep, schema)


def verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """pairs (a, b) of classes, each once -> the links among them, by whole sets, saved. classes: key, doc (a doc_id of it), rep."""
    pairs = save(pairs, "candidates")
    ids = save(pairs.select("a").union(pairs.select("b")).distinct().toDF("rep").join(classes, "rep"), "ids")
    few = counted_at_most(ids, BROADCAST_IDS)
    side = lambda df: F.broadcast(df) if few else df
    some = docs.select(F.col("doc_id").cast("long"), "text").join(side(ids.select("doc").distinct()), F.col("doc_id") == F.col("doc"), "left_semi")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # rows that repeat in a task give their set once; only a cache
        for _, sets in _sets(batches, k):
            new = []
            for s in sets:
                if (key := xxhash.xxh3_128_digest(s.tobytes())) not in seen:
                    new.append((key, s))
                    seen = seen if len(seen) < 200_000 else set()
                    seen.add(key)
            yield pa.RecordBatch.from_arrays([pa.array([key for key, _ in new], pa.binary()), _lists([s for _, s in new])], names=["key", "s"])

    sets = save(some.mapInArrow(scan, "key binary, s array<long>").join(side(ids.select("key", "rep")), "key").select(F.col("rep").alias("id"), "s"), "sets")
    used_up = [pairs, ids, sets]
    if sets.count() > ids.count():
        sets = save(sets.dropDuplicates(["id"]), "sets")
        used_up.append(sets)
    joined = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    links = save(joined.where(both * (den + num) >= (F.size("sa") + F.size("sb")) * num).select("a", "b"), "links")
    discard(*used_up)
    return links


def _pairs_of_runs(at: np.ndarray, stop: np.ndarray, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) within runs [at, stop): of one block all pairs, of two blocks those across."""
    size = stop - at
    small = size <= 16
    starts, ends = at[small], stop[small]
    for d in range(1, int(size[small].max()) if len(starts) else 1):
        reach = np.repeat(ends - d - starts, 1)
        use = reach > 0
        n = reach[use]
        if not len(n):
            break
        first = np.repeat(starts[use] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        yield first, first + d
    for a, b in zip(at[~small].tolist(), stop[~small].tolist(), strict=True):
        mine = np.arange(a, b)
        one = np.unique(block[a:b])
        if len(one) == 1:
            left, right, across = mine, mine, False
        else:
            left, right, across = mine[block[a:b] == one[0]], mine[block[a:b] == one[1]], True
        for k in range(0, len(left), 256):
            i, j = (x.ravel() for x in np.meshgrid(left[k : k + 256], right, indexing="ij"))
            yield (i, j) if across else (i[i < j], j[i < j])


class Maps:
    """Parity maps of many rows (null: none), folded to MAP_BYTES at most, for vectorised comparison."""

    def __init__(self, maps: list[bytes | None]):
        held = [m if m is None or len(m) <= MAP_BYTES else folded(m, MAP_BYTES) for m in maps]
        self.size = np.array([0 if m is None else len(m) for m in held], np.int64)
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted(set(self.size.tolist()) - {0}):
            rows = np.flatnonzero(self.size >= size)
            place = np.full(len(held), -1, np.int64)
            place[rows] = np.arange(len(rows))
            bits = np.frombuffer(b"".join(folded(held[r], size) for r in rows.tolist()), np.uint64).reshape(-1, size // 8)
            self.levels[size] = place, bits

    def close(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether rows i and j differ in at most `most` bits, in the size of the smaller map; true where one has none."""
        least, ok = np.minimum(self.size[i], self.size[j]), np.ones(len(i), bool)
        for size, (place, bits) in self.levels.items():
            at = np.flatnonzero(least == size)
            if len(at):
                ok[at] = np.bitwise_count(bits[place[i[at]]] ^ bits[place[j[at]]]).sum(axis=1, dtype=np.int64) <= most[at]
        return ok


def in_blocks(rows: DataFrame, key: list[str], block: int = BLOCK) -> DataFrame:
    """rows (key, id, m, ...) with columns i, j, block: buckets (key) of m rows, over `block`, are cut into blocks, and each pair of blocks is a key of its own."""
    rows = rows.withColumn("blocks", F.ceil(F.col("m") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")


def unconnected_pairs(rows: DataFrame, key: list[str], num: int, den: int) -> DataFrame:
    """rows (key, i, j, block, id, n, low, high, map, heads) -> (a, b, na, nb, shared): pairs of ids that may link two components.

    low, high: the least and greatest component of what an id stands for. map: null if it
    stands for several sets. heads: null in buckets that give all their pairs, else the
    first large buckets that the id is in; a pair that meets in an earlier one of these is
    left to that. shared: in how many buckets with null heads the pair was seen, or UNCOUNTED
    and more.
    """
    rows = rows.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j", "block").select(*key, "i", "j", "block", "id", "n", "low", "high", "map", "heads")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_runs(batches, [*key, "i", "j"]):
            col = {c: part.column(c).to_numpy() for c in (*key, "i", "j", "block", "id", "n", "low", "high")}
            maps, heads = Maps(part.column("map").to_pylist()), _padded(part.column("heads").to_pylist())
            counts = np.where(part.column("heads").is_null().to_numpy(), 1, UNCOUNTED)
            new = np.flatnonzero(np.concatenate(([True], np.any([np.diff(col[c]) != 0 for c in (*key, "i", "j")], axis=0))))
            found, held = [], 0
            for i, j in _pairs_of_runs(new, np.append(new[1:], len(col["i"])), col["block"]):
                # A pair of unlike blocks takes pairs across them only.
                ok = (col["i"][i] == col["j"][i]) | (col["block"][i] != col["block"][j])
                ok &= (np.minimum(col["low"][i], col["low"][j]) != np.maximum(col["high"][i], col["high"][j])) & (col["id"][i] != col["id"][j])
                i, j = i[ok], j[ok]
                m, n = col["n"][i], col["n"][j]
                ok = np.minimum(m, n) * den >= np.maximum(m, n) * num
                i, j, n = i[ok], j[ok], (m + n)[ok]
                ok = maps.close(i, j, (den - num) * n // (den + num))
                i, j = i[ok], j[ok]
                ok = ~_met_before(heads, i, j, col[key[0]])
                i, j = i[ok], j[ok]
                swap = col["id"][i] > col["id"][j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                found.append(np.stack([col["id"][i], col["id"][j], col["n"][i], col["n"][j], counts[i]], axis=1))
                held += len(i)
                if held > 200_000:
                    yield _counted(found)
                    found, held = [], 0
            if held:
                yield _counted(found)

    pairs = rows.mapInArrow(pair, "a long, b long, na long, nb long, shared long")
    return pairs.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))


def _padded(heads: list[list[int] | None]) -> np.ndarray:
    """A row of HEADS shingles for each list, sorted, filled up with the largest number."""
    out = np.full((len(heads), HEADS), np.iinfo(np.int64).max)
    for k, found in enumerate(heads):
        if found:
            out[k, : len(found)] = found
    return out


def _met_before(heads: np.ndarray, i: np.ndarray, j: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether the heads of i and j share a shingle before their bucket's own."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 20_000):
        one = slice(at, at + 20_000)
        a = heads[i[one]]
        a = np.where(a < bucket[i[one], None], a, -1)[:, :, None]
        out[one] = ((a == heads[j[one]][:, None, :]) & (a != -1)).any(axis=(1, 2))
    return out


def exact_round(index: DataFrame, members: DataFrame, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """index (token, gid), members (gid, rep, n, component, map, fold) -> candidate pairs (a, b, na, nb) of members in different components.

    Groups are paired first, over all shingles that their prefixes share. What two sets
    share beyond the prefix that ends first is at most the rest of that set, so a pair
    whose count is too small for that is out. Then pairs with a group of several members,
    and such groups on their own, are expanded.
    """
    alone = lambda c: F.when(F.count("*") == 1, F.first(c)).alias(c)
    groups = members.groupBy("gid").agg(F.first("n").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), alone("map"), alone("fold"), F.count("*").alias("size"))
    groups = save(groups, "grouped")
    # Buckets are cut before their rows get maps, so that maps are dealt once; small buckets take the small ones.
    index = index.withColumnRenamed("gid", "id")
    index = save(index.join(index.groupBy("token").agg(F.count("*").alias("m")), "token"), "index")
    firsts = index.where(F.col("m") > FEW).groupBy("id").agg(F.slice(F.sort_array(F.collect_set("token")), 1, HEADS).alias("heads"))
    rows = in_blocks(index, ["token"], block).join(groups.drop("size").withColumnRenamed("gid", "id").join(firsts, "id", "left"), "id")
    few = F.col("m") <= FEW
    rows = rows.withColumns({"map": F.when(few, F.col("fold")).otherwise(F.col("map")), "heads": F.when(~few, F.col("heads"))})
    pairs = unconnected_pairs(rows, ["token"], num, den)
    rest = F.ceil(F.greatest("na", "nb") * num / den) - 1
    pairs = save(pairs.where((F.col("shared") + rest) * (den + num) >= (F.col("na") + F.col("nb")) * num).drop("shared"), "group_pairs")

    large = groups.where("size > 1").select("gid", "size", "low", "high")
    sized = pairs.join(large.select(F.col("gid").alias("a"), F.col("size").alias("size_a")), "a", "left").join(large.select(F.col("gid").alias("b"), F.col("size").alias("size_b")), "b", "left")
    sized = save(sized.fillna(1, ["size_a", "size_b"]), "sized_pairs")
    single = F.greatest("size_a", "size_b") == 1
    out = sized.where(single).select("a", "b", "na", "nb")
    wide = sized.where(~single).withColumns({"blocks_a": F.ceil(F.col("size_a") / block).cast("int"), "blocks_b": F.ceil(F.col("size_b") / block).cast("int")})
    many = members.join(large.select("gid"), "gid", "left_semi")
    named = members.select(F.col("gid").alias("of"), F.col("rep").alias("id"), "n", F.col("component").alias("low"), F.col("component").alias("high"), "map")
    mine = lambda blocks: F.pmod(F.xxhash64("id", F.lit(7)), F.col(blocks)).cast("int")
    met = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)).alias("met")
    # The blocks of a come first, then those of b; a row goes to each block of the other group.
    left = wide.select("a", "b", "blocks_a", met("blocks_b")).join(named, F.col("a") == F.col("of")).withColumns({"i": mine("blocks_a"), "j": F.col("blocks_a") + F.col("met")}).withColumn("block", F.col("i"))
    right = wide.select("a", "b", "blocks_a", "blocks_b", met("blocks_a")).join(named, F.col("b") == F.col("of")).withColumns({"i": F.col("met"), "j": F.col("blocks_a") + mine("blocks_b")}).withColumn("block", F.col("j"))
    own = many.select(F.col("gid").alias("a"), F.col("gid").alias("b"), F.col("rep").alias("id"), "n", F.col("component").alias("low"), F.col("component").alias("high"), "map")
    own = in_blocks(own.join(large.where(F.col("low") != F.col("high")).select(F.col("gid").alias("a")), "a", "left_semi").join(large.select(F.col("gid").alias("a"), F.col("size").alias("m")), "a"), ["a", "b"], block)
    shape = ["a", "b", "i", "j", "block", "id", "n", "low", "high", "map"]
    expanded = left.select(shape).unionByName(right.select(shape)).unionByName(own.select(shape)).withColumnsRenamed({"a": "g", "b": "h"}).withColumn("heads", F.lit(None).cast("array<long>"))
    return out.unionByName(unconnected_pairs(expanded, ["g", "h"], num, den).drop("shared")).distinct()


def _counted(found: list[np.ndarray]) -> pa.RecordBatch:
    rows, at = np.unique(np.concatenate(found)[:, :4], axis=0, return_inverse=True)
    shared = np.zeros(len(rows), np.int64)
    np.add.at(shared, at.ravel(), np.concatenate(found)[:, 4])
    return pa.RecordBatch.from_arrays([*(pa.array(rows[:, k]) for k in range(4)), pa.array(shared)], names=["a", "b", "na", "nb", "shared"])


def _whole_runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows, sorted, in tables that never part those equal in `by`: at most two blocks of rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        if rows.num_rows < 20_000:
            continue
        last = np.flatnonzero(np.any([k != k[-1] for k in (rows.column(c).to_numpy() for c in by)], axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield rows.slice(0, cut).combine_chunks()
        held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def jaccard_rows(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs (doc_id, text) -> doc_id, h, n, component, component_id of each row, saved; links: Jaccard >= num / den.

    component: a number of the component, null where a row links with nothing.
    """
    with tables_made() as made:
        rows = _rows(docs, k, num, den)
    kept_of(made, rows)
    return rows


def _rows(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    first = save(scan_sets(docs, k, num, den, with_maps=False).drop("map", "fold", "heat"), "sets1")
    rows = save(first.select("doc_id", "h", "n", "key"), "rows")
    classes = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("doc"))
    classes = save(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    counted = first.select(F.explode("prefix").alias("token")).groupBy("token").count().where(F.col("count") > HOT_COUNT)
    hot = np.array([r[0] for r in counted.orderBy(F.desc("count"), "token").limit(HOT_SHINGLES).select("token").collect()], np.int64).view(np.uint64)
    discard(first)

    # Classes in the final order, and their groups.
    again = scan_sets(docs, k, num, den, hot).join(classes, "key").where(F.col("doc_id") == F.col("doc")).drop("doc_id", "h", "key", "doc")
    members = save(again.dropDuplicates(["rep"]).withColumn("prefix_key", F.xxhash64("prefix", "n")), "members")
    groups = members.groupBy("prefix_key", "n").agg(F.min("rep").alias("gid"), F.count("*").alias("size"), F.min_by("map", "rep").alias("map"), F.min_by("heat", "rep").alias("heat"), F.min_by("prefix", "rep").alias("prefix"))
    groups = save(groups.withColumn("map", F.when(F.col("size") == 1, F.col("map"))), "groups")

    # Buckets of two classes or more: most shingles have one, and a plain count finds those first.
    index = groups.select(F.explode("prefix").alias("token"), "gid", "n", "heat", "size")
    many = index.groupBy("token").agg(F.sum("size").alias("s")).where(F.col("s") > 1).select("token")
    shared = save(index.drop("size").join(many, "token"), "shared")
    slim = save(groups.drop("prefix", "heat"), "groups")
    discard(groups)
    groups = slim
    # The groups of a bucket that round 1 compares the others to.
    entry = F.struct("gid", "n")
    heads = shared.groupBy("token").agg(
        F.max(F.struct("heat", (-F.col("gid")).alias("o"), entry.alias("e")))["e"].alias("lead"),
        F.min(F.struct(F.xxhash64("token", "gid").alias("o"), entry.alias("e")))["e"].alias("any"),
    )
    buckets = save(shared.drop("heat").join(heads, "token"), "buckets")
    discard(shared)
    met = buckets.select(F.col("gid").alias("g"), F.col("n").alias("na"), F.explode(F.array("lead", "any")).alias("h"))
    met = met.where((F.col("g") != F.col("h.gid")) & _linkable("na", "h.n", num, den)).select("g", "na", F.col("h.gid").alias("h"), F.col("h.n").alias("nb")).distinct()
    maps = groups.select("gid", "map")
    met = met.join(maps.toDF("g", "map_a"), "g").join(maps.toDF("h", "map_b"), "h")
    near = filter_by_maps(met, num, den).select("g", "h")
    group_of = members.select("prefix_key", "n", "rep").join(groups.where("size > 1").select("prefix_key", "n", "gid"), ["prefix_key", "n"])
    inside = group_of.select("gid", "rep")
    # A group's members meet the other group's first member; members of one group meet their first.
    near = near.union(near.select("h", "g")).distinct().join(inside.toDF("g", "m"), "g", "left").select(F.coalesce("m", "g").alias("x"), F.col("h").alias("y"))
    near = near.union(inside.where(F.col("rep") != F.col("gid")).select("rep", "gid"))
    links = verify(docs, classes, near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), k, num, den)
    known = save(components(links), "components")

    # Round 2: buckets whose members are not all connected.
    member = members.select("rep", "map", "fold", "prefix_key", "n").join(known.toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    member = member.join(groups.select("prefix_key", "n", "gid"), ["prefix_key", "n"])
    member = save(member.select("gid", "rep", "n", "component", "map", "fold"), "placed")
    discard(members, groups)
    ends = member.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    opened = buckets.select("token", "gid").join(ends, "gid").groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high")).where(F.col("low") != F.col("high")).select("token")
    close = exact_round(buckets.select("token", "gid").join(opened, "token"), member, num, den)
    maps = member.select("rep", "map")
    close = filter_by_maps(close.join(maps.toDF("a", "map_a"), "a").join(maps.toDF("b", "map_b"), "b"), num, den)
    more = verify(docs, classes, close.select("a", "b"), k, num, den)
    found = components(links.union(more))

    # Back to rows. A component's least doc_id stands for it.
    named = save(classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("key").alias("c_key"), "doc", F.coalesce("component", "rep").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("doc").alias("least"))
    named = named.drop("doc").join(least, "component")
    links_with_some = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = rows.join(named, links_with_some & (F.col("key") == F.col("c_key")), "left")
    return save(out.select("doc_id", "h", "n", "component", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id")), "components")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id; links: Jaccard >= num / den."""
    return jaccard_rows(docs, k, num, den).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with the smallest doc_id. Documents without a doc_id or words stay, each once."""
    rows = jaccard_rows(docs.select("doc_id", "text"))
    row = F.struct("doc_id", "h")
    stays = rows.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(row).alias("stays"))
    gone = save(rows.join(stays, "component").where(row != F.col("stays")).select("doc_id", "h").distinct(), "gone")
    again = rows.where("n > 0").groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h")
    again = save(again.join(gone.toDF("g", "g_h"), F.col("doc_id").eqNullSafe(F.col("g")) & (F.col("h") == F.col("g_h")), "left_anti"), "again")
    discard(rows)
    return without(docs, gone, again)
