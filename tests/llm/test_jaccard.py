import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import components, jaccard

from .helpers import DOCS, odd_documents, write


def shingles(text, k):
    ws = (text or "").encode().translate(jaccard.FOLD).split()
    return frozenset(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if len(ws) >= k else frozenset([tuple(ws)] if ws else [])


def truth(rows, k, num, den):
    """Brute force over all pairs that share a shingle."""
    sets = {d: shingles(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    for d, s in sets.items():
        for e, both in Counter(e for x in s for e in by[x] if e > d).items():
            if den * both >= num * (len(s) + len(sets[e]) - both):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_copies(seed, n=120):
    """Groups of near copies at all distances around the threshold, chains among them, and shared passages."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randint(0, 5000)
    passage, texts = [word() for _ in range(60)], []
    for _ in range(6):
        base = [word() for _ in range(rng.choice([8, 30, 90, 150]))]
        for _ in range(n // 6):
            t = list(rng.choice([base, base, texts[-1] if texts else base]))
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 2)] = [word() for _ in range(rng.randint(0, 2))]
            texts.append(t or [word()])
    texts += [[word() for _ in range(30)] + passage + [word() for _ in range(rng.randint(5, 60))] for _ in range(40)]
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


def run(spark, rows, k, num, den):
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, component string, n int")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(frame, k, num, den).collect()}


@pytest.mark.parametrize(("seed", "k", "num", "den"), [(1, 4, 85, 100), (2, 5, 80, 100)])
def test_near_copies_against_brute_force(spark, seed, k, num, den, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_COUNT", 4)
    rows = near_copies(seed)
    assert run(spark, rows, k, num, den) == truth(rows, k, num, den)


MEMBERS = "gid long, rep long, n long, component long, map binary, fold binary"


@pytest.mark.parametrize("groups", [100, 10, 1])
def test_blocks_cover_all_pairs(spark, groups):
    """Buckets and groups far over the block size give what one block gives: members of one group, or of two."""
    members = spark.createDataFrame([(r % groups, r, 1, r, bytes(64), bytes(16)) for r in range(100)], MEMBERS)
    index = spark.createDataFrame([(1, g) for g in range(groups)], "token long, gid long")
    got = [tuple(r) for r in jaccard.exact_round(index, members, 85, 100, block=7).collect()]
    assert sorted(got) == [(a, b, 1, 1) for a in range(100) for b in range(a + 1, 100)]


def test_a_pair_leaves_one_of_its_large_buckets(spark):
    """90 groups that share 40 shingles each, and 10 that share other ones: pairs are made once, not 40 times."""
    members = spark.createDataFrame([(r, r, 1, r, bytes(64), bytes(16)) for r in range(100)], MEMBERS)
    index = [(t, g) for g in range(90) for t in range(-20, 20)] + [(t, g) for g in range(90, 100) for t in range(100, 103)]
    index = spark.createDataFrame(index, "token long, gid long")
    seen, real = [], jaccard.save
    pairs = jaccard.unconnected_pairs
    try:
        jaccard.unconnected_pairs = lambda *a: seen.append(real(pairs(*a), "p")) or seen[-1]
        got = [tuple(r)[:2] for r in jaccard.exact_round(index, members, 85, 100, block=32).collect()]
    finally:
        jaccard.unconnected_pairs = pairs
    assert sorted(got) == [(a, b) for a in range(100) for b in range(a + 1, 100) if (a < 90) == (b < 90)]
    assert {r["shared"] for r in seen[0].collect()} == {jaccard.UNCOUNTED, 3}


def test_no_pair_of_connected_or_far_members(spark):
    """One bucket of 600: pairs leave the tasks only where components and maps leave a link open."""
    near, far = bytes(64), bytes([255]) * 64
    rows = [(r, r, 50, 0 if r < 500 else r, near if r < 510 else far) for r in range(600)]
    members = spark.createDataFrame([(*x, x[-1][:16]) for x in rows], MEMBERS)
    flat = members.select(F.lit(1).alias("token"), F.col("gid").alias("id"), "n", F.col("component").alias("low"), F.col("component").alias("high"), "map", F.lit(600).alias("m"), F.lit(None).cast("array<long>").alias("heads"))
    made = jaccard.unconnected_pairs(jaccard.in_blocks(flat, ["token"], 64), ["token"], 85, 100)
    # 10 strays meet the 500 that are connected, and each other; the 90 far ones meet each other only.
    assert made.count() == 10 * 500 + 45 + 90 * 89 // 2
    members = spark.createDataFrame([(7, *x[1:], x[-1][:16]) for x in rows], MEMBERS)
    index = spark.createDataFrame([(1, 7)], "token long, gid long")
    assert jaccard.exact_round(index, members, 85, 100, block=64).count() == 10 * 500 + 45 + 90 * 89 // 2


def test_small_documents(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.op6_ngram_jaccard(spark, small).collect()}
    assert got == truth(rows, 4, 85, 100)


def test_odd_documents(spark, tmp_path):
    rows = odd_documents()
    got = jaccard.op6_ngram_jaccard(spark, write(spark, tmp_path / "o", rows)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    want = truth([(r[0], r[1]) for r in rows if r[0] is not None], 4, 85, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert jaccard.op6_ngram_jaccard(spark, write(spark, tmp_path / "e", [])).count() == 0
    kept = jaccard.stage(spark, spark.createDataFrame(rows, DOCS), "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {9} == {9, 10} & {r["doc_id"] for r in kept.collect()}


def test_parity_maps_never_overrate_the_difference():
    rng = np.random.default_rng(3)
    for n, m in ((5, 5), (300, 290), (700, 500), (3000, 2800), (1100, 1000)):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate((a[: m // 2], rng.integers(0, 2**63, m - m // 2).astype(np.uint64)))
        apart = jaccard.bits_apart(jaccard.parity_map(a), jaccard.parity_map(b))
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_chains_and_stars(spark, seed):
    rng = random.Random(seed)
    links = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(1001, 1080)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def row_truth(rows, k, num, den):
    """Brute force by row: the least doc_id that a row's text reaches; null and empty rows link with nothing."""
    linked = [i for i, (d, t) in enumerate(rows) if d is not None and shingles(t, k)]
    sets = {i: shingles(rows[i][1], k) for i in linked}
    parent = {i: i for i in linked}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in linked:
        for b in linked:
            if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                parent[find(b)] = find(a)
    least = {}
    for i in linked:
        least[find(i)] = min(rows[i][0], least.get(find(i), rows[i][0]))
    return [(d, len(shingles(t, k)), least[find(i)] if i in parent else d) for i, (d, t) in enumerate(rows)], {i: find(i) for i in linked}


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_that_share_doc_ids_and_null_ids(spark, seed):
    rng = random.Random(seed)
    texts = [t for _, t in near_copies(seed)]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts)) for _ in range(160)] + [(1, ""), (None, None), (2, " ")]
    rows += rows[:30]
    got = spark.createDataFrame(rows, "doc_id long, text string")
    want, component = row_truth(rows, 5, 80, 100)
    assert Counter(tuple(r) for r in jaccard.jaccard_components(got).collect()) == Counter(want)
    # The stage keeps one row of each component, and one of equal rows without a doc_id.
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard.stage(spark, got.selectExpr("*", "1 AS h", "2 AS _g_doc"), "").collect())
    by = defaultdict(set)
    for i, c in component.items():
        by[c].add(rows[i])
    assert sum(1 for k in kept.elements() if k[0] is not None and shingles(k[1], 5)) == len(by)
    for own in by.values():
        stays = [k for k in own if k in kept]
        assert len(stays) == 1 and kept[stays[0]] == 1 and stays[0][0] == min(d for d, _ in own)
    for k in set(rows):
        if k[0] is None and shingles(k[1], 5):
            assert kept[k] == 1
        elif not shingles(k[1], 5):
            assert kept[k] == rows.count(k)


def test_texts_of_one_doc_id_keep_their_links(spark):
    x = [" ".join(f"x{k}" for k in range(40)), " ".join(f"x{k}" for k in range(1, 41))]
    y = [" ".join(f"y{k}" for k in range(40)), " ".join(f"y{k}" for k in range(1, 41))]
    frame = spark.createDataFrame([(1, x[0]), (1, y[0]), (2, x[1]), (3, y[1])], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(frame).collect()} == {(1, 1), (2, 1), (3, 1)}
    frame = spark.createDataFrame([(1, x[0]), (2, x[1]), (2, y[0])], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in jaccard.stage(spark, frame, "").collect()) == [(1, x[0]), (2, y[0])]
