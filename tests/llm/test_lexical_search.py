import math
import re
from collections import Counter

import duckdb
import pytest

from sluice.llm import lexical_search as ls

from .helpers import odd_documents, write

A_TO_Z = {k: k + 32 for k in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z))


def brute(docs, items, top=10):
    own = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item_id, text in items:
        wanted, scores = Counter(terms(text)), []
        for d, c in own:
            m = 100 - 75 + (75 * c.total() * n_docs) // max(n_terms, 1)
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in wanted.items() if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item_id, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=repr)


def test_whole_tables_against_brute_force_and_sql(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    got = rows(ls.op13_lexical_search(spark, small))
    assert got == brute(docs, items)
    for t in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    assert sorted((tuple(r) for r in duckdb.sql(ls.OP13_SQL).fetchall()), key=repr) == got


ITEMS = [(0, "tie"), (1, "word5 word6 WORD5 word900"), (2, ""), (3, None), (4, "no such term as qqq"), (5, "ünïcödé ÀÉ é́"), (None, "one two"), (6, "tie"), (6, "one a b")]


@pytest.mark.parametrize("block,first,batch", [(128, 4, 200_000), (2, 1, 5), (1, 1, 200_000)])
def test_odd_texts_ties_and_batches(spark, tmp_path, monkeypatch, block, first, batch):
    for k, v in (("BLOCK", block), ("FIRST", first), ("QUERY_TERMS", batch)):
        monkeypatch.setattr(ls, k, v)
    docs = odd_documents() + [(200 + k, "tie" + " more" * (k % 3) + " one" * (k % 5), "en", "s", 0) for k in range(60)] + [(None, "tie", None, None, None)] * 2
    path = write(spark, tmp_path, docs)
    write(spark, tmp_path, ITEMS, "item_id long, text string", "benchmark")
    assert rows(ls.op13_lexical_search(spark, path)) == brute([d[:2] for d in docs], ITEMS)


def test_blocks_are_pruned_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(ls, "BLOCK", 4)
    docs = [(k, f"common filler{k % 7} " * 3 + ("rare" if k % 100 == 3 else "")) for k in range(1200)]
    items = [(1, "rare"), (2, "common filler3"), (3, "common")]
    scored = []
    plain = ls.score_blocks
    monkeypatch.setattr(ls, "score_blocks", lambda index, pairs, *a: (scored.append(pairs.groupBy("item").count().collect()), plain(index, pairs, *a))[1])
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = ls.search(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == brute(docs, items)
    blocks = Counter()
    for x in scored:
        blocks.update({r["item"]: r["count"] for r in x})
    assert min(blocks.values()) <= 12 and max(blocks.values()) <= 303  # only twelve of about 300 blocks hold the rare term


def test_empty_tables_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 7, 3)], "doc_id int, text string, score int, block int")
    items = spark.createDataFrame([(1, "a", 2)], "item_id int, text string, rank int")
    assert rows(ls.search(docs, items)) == brute([(1, "a b")], [(1, "a")])
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        assert ls.search(d, i).collect() == []
