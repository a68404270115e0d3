import zlib
from collections import Counter, defaultdict

import numpy as np

from sluice.llm import sharding, url_filters

from .helpers import DOCS, odd_documents, write


def check_shards(rows, got, shards=16):
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    assert set(slots) <= set(range(shards))
    return sizes, slots


def test_small_documents_are_balanced(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = sharding.op4_vector_shards(spark, small).collect()
    sizes, slots = check_shards(rows, got)
    assert max(sizes.values()) <= 1.15 * max(sum(sizes.values()) / 16, max(r["size"] for r in got))
    text = {r[0]: r[1] for r in rows}
    where = defaultdict(set)
    for r in got:
        where[text[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def plain_packing(items, capacity):
    residual, out = [list(c) for c in capacity], [None] * len(items)
    mean = [max(sum(abs(c[d]) for c in capacity) / len(capacity), 1e-9) for d in range(3)]
    for k in sorted(range(len(items)), key=lambda k: (-max(items[k][d] / mean[d] for d in range(3)), k)):
        dots = [sum(r[d] / mean[d] * items[k][d] / mean[d] for d in range(3)) for r in residual]
        out[k] = max(range(len(dots)), key=lambda b: (round(dots[b], 9), -b))
        residual[out[k]] = [r - x for r, x in zip(residual[out[k]], items[k], strict=True)]
    return out


def test_packing_against_brute_force():
    rng = np.random.default_rng(4)
    items = np.stack([rng.integers(1, 5000, 300), rng.integers(1, 900, 300), rng.integers(1, 4, 300)], axis=1).astype(float)
    capacity = np.tile(items.sum(axis=0) / 7, (7, 1)) * rng.uniform(0.8, 1.2, (7, 1))
    assert sharding.pack_vectors(items, capacity).tolist() == plain_packing(items.tolist(), capacity.tolist())
    assert sharding.pack_vectors(np.empty((0, 3)), capacity).tolist() == []


def test_many_bins_balance_bytes_tokens_and_rows(spark, small):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{small}/documents.parquet").limit(10**6)
    rows = [(k * 1000 + d, f"{t} {k}") for d, t in ((r["doc_id"], r["text"][:700]) for r in docs.collect() if r["text"]) for k in range(15)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign_shards(frame, 8, groups=300).collect()
    check_shards(rows, got, 8)
    for what in (lambda r: r["size"], lambda r: r["n_tokens"], lambda r: 1):
        sums = Counter()
        for r in got:
            sums[r["shard"]] += what(r)
        assert max(sums.values()) <= 1.03 * sum(sums.values()) / 8 and min(sums.values()) >= 0.97 * sum(sums.values()) / 8
    tokenizer, text = Tokenizer.from_file(sharding.vocabulary("byte_bpe_50k.json")), dict(rows)
    assert all(r["n_tokens"] == len(tokenizer.encode(text[r["doc_id"]], add_special_tokens=False).ids) + 1 for r in got[:200])


def test_hot_group_is_split_and_odd_rows_are_kept(spark, tmp_path):
    rows = odd_documents() + [(1000 + k, "the same text again", "en", "s", 19) for k in range(600)] + [(5000 + k, f"own text {k} " * (k % 7), "en", "s", 0) for k in range(1200)]
    frame = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"lang": "item", "source": "slot"})
    sizes, slots = check_shards(rows, sharding.assign_shards(frame, 4).collect(), 4)
    assert max(map(len, slots.values())) < 0.4 * len(rows)
    assert sharding.op4_vector_shards(spark, write(spark, tmp_path / "e", [])).count() == 0


def test_written_shards_hold_all_documents(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = sharding.write_shards(docs, f"{tmp_path}/s", 4)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted(r[0] for r in back.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())
    assert {tuple(r) for r in back.select("doc_id", "shard").collect()} == {tuple(r) for r in plan.select("s_doc", "shard").collect()}


def test_vectors_balance_in_all_dimensions():
    rng = np.random.default_rng(4)
    items = np.stack([rng.lognormal(6, 1, 3000), rng.lognormal(4, 1, 3000), np.ones(3000)], axis=1).astype(np.int64)
    bins = sharding.pack_vectors(items, np.tile(items.sum(axis=0) / 8, (8, 1)))
    loads = np.stack([items[bins == b].sum(axis=0) for b in range(8)])
    assert (loads.max(axis=0) <= 1.05 * loads.mean(axis=0)).all()


URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.NET/en/x?q=/de/", "http://a.example.net/en", "http://xexample.net/en/", "https://b.example.com/de/1#x", "https://example.org/fr/", "http://org/fr/?x", "http://net", "http://net/", "a://b://c/d", "http://É.net/x", "http://a..net/", "http://" + "a." * 3000 + "net/" + "x/" * 3000]


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    at = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:at].translate(str.maketrans(url_filters.UPPER, url_filters.LOWER)), rest[at:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_urls_against_brute_force(spark, small):
    rules = [*url_filters.RULES, ("com", "/d", "block"), ("b.example.com", "/de/1", "allow"), ("example.net", "/en", "block")]
    urls = URLS + [r[0] for r in spark.read.parquet(f"{small}/pages.parquet").select("url").collect()]
    pages = spark.createDataFrame([(k, u, "old") for k, u in enumerate(urls)] + [(3, urls[3], "old")], "page_id long, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in url_filters.judge(pages, table).collect())
    want = sorted((k, h, p, r or "", v) for k, u in [*enumerate(urls), (3, urls[3])] for h, p, r, v in [judged(u, rules)])
    assert got == want
    none = url_filters.judge(pages, table.where("false"))
    assert {r["verdict"] for r in none.collect()} == {"allow"} and none.count() == len(want)
    assert url_filters.judge(pages.where("false"), table).count() == 0
