import itertools
import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import chat
from sluice.llm import decontaminate as dc

from .helpers import DOCS, odd_documents


def test_masks_hit_all_windows_that_count():
    """Windows of 12 to 23 words, and of 8 to 11 in short items, with as many substitutions as 80 % leaves."""
    for n in range(8, 24):
        for gone in itertools.combinations(range(n), n - -(-n * 80 // 100)):
            assert any(not any(p + o in gone for o in mask) for mask in dc.MASKS for p in range(n - mask[-1])), (n, gone)


def plain_overlaps(docs, items, least_words=12, percent=80):
    """All diagonals, all windows."""
    out = []
    for d, t in docs:
        words = dc.RUN.findall((t or "").lower())
        for i, x in items:
            own = dc.RUN.findall((x or "").lower())
            n = len(own)
            for shift in range(1 - n, len(words)):
                a, b = max(0, -shift), min(n, len(words) - shift)
                same = [own[k] == words[k + shift] for k in range(a, b)]
                least = n if n < 8 else min(least_words, max(8, n * percent // 100))
                share = 100 if n < 8 else percent
                covered = set()
                for size in range(least, len(same) + 1) if n else []:
                    for at in range(len(same) - size + 1):
                        if 100 * sum(same[at : at + size]) >= share * size:
                            covered.update(range(at, at + size))
                k = 0
                while k < len(same):
                    if k in covered:
                        end = k
                        while end in covered:
                            end += 1
                        equal = [j for j in range(k, end) if same[j]]
                        out.append((d, i, a + equal[0] + shift, a + equal[0], equal[-1] - equal[0] + 1, len(equal)))
                        k = end
                    k += 1
    return sorted(out, key=str)


def test_overlaps_with_substitutions_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "v%d" % rng.randint(0, 400)
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 3, 5, 7, 7, 8, 8, 9, 10, 11, 12, 13, 15, 16, 20, 24, 30, 40])]
    items += [(None, "solo words of an item without an id stand here"), (90, None), (91, ""), (92, items[12][1])]
    docs = []
    for d in range(120):
        ws = [word() for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            own = (rng.choice(items)[1] or "").split()
            at = rng.randint(0, max(0, len(own) - 8))
            part = own[at : at + rng.randint(7, 25)]
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                if part:
                    part[rng.randrange(len(part))] = word()
            ws += part + [word() for _ in range(rng.randint(0, 5))]
        docs.append((d if d % 10 else None, " ".join(ws)))
    got = dc.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = plain_overlaps(docs, items)
    assert sorted(map(tuple, got), key=str) == want and len(want) > 100 and len({w[4] - w[5] for w in want}) > 3


def plain_stretches(same, least, percent):
    covered = set()
    for size in range(least, len(same) + 1):
        for at in range(len(same) - size + 1):
            if 100 * sum(same[at : at + size]) >= percent * size:
                covered.update(range(at, at + size))
    out, k = [], 0
    while k < len(same):
        if k in covered:
            end = k
            while end in covered:
                end += 1
            equal = [j for j in range(k, end) if same[j]]
            out.append((equal[0], equal[-1] - equal[0] + 1, len(equal)))
            k = end
        k += 1
    return out


@pytest.mark.parametrize("n", [12, 20, 30, 40, 60, 100, 120])
def test_extents_over_all_windows(n):
    """Runs of up to 120 words, with exactly 20 % substituted words and with other shares."""
    rng = np.random.default_rng(n)
    for k in range(60 if n <= 60 else 12):
        gone = n // 5 if k % 3 else int(rng.integers(0, n))
        same = np.ones(n, bool)
        same[rng.choice(n, gone, replace=False)] = False
        own = np.arange(n)
        assert dc.stretches(own, np.where(same, own, -1), 12, 80, n) == plain_stretches(same.tolist(), min(12, max(8, n * 80 // 100)), 80), (n, k)


def test_recall_of_planted_overlaps_with_substitutions(spark):
    """Passages of 15 to 60 words of items, with 0 to 3 words substituted: all are found, over their whole extent or more."""
    rng = random.Random(8)
    items = [(k, " ".join("b%d" % rng.randint(0, 9000) for _ in range(rng.randint(20, 120)))) for k in range(60)]
    docs, want = [], {}
    for d in range(400):
        item, text = rng.choice(items)
        ws = text.split()
        n = rng.randint(15, min(60, len(ws)))
        at = rng.randrange(len(ws) - n + 1)
        part = ws[at : at + n]
        inside = rng.sample(range(1, n - 1), d % 4)
        for k in inside:
            part[k] = "changed"
        lead = ["c%d" % rng.randint(0, 9000) for _ in range(rng.randint(0, 40))]
        docs.append((d, " ".join([*lead, *part, "tail"])))
        want[d, item] = (len(lead), n)
    got = {(r["doc_id"], r["item_id"]): (r["doc_start"], r["length"]) for r in dc.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


def test_short_items_remove_nothing_but_are_found(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "of one two three four here"), (3, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the"), (2, "one two three four"), (3, "one two")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in dc.find_overlaps(docs, items).collect()} == {(1, 1), (2, 2), (2, 3)}
    assert {r["doc_id"] for r in dc.remove(docs, items).collect()} == {1, 3}
    assert dc.benchmark(items, dc.REMOVE_WORDS).n_left_out == 2
    assert {r["doc_id"] for r in dc.remove(docs, items, min_item_words=1).collect()} == {3}


def test_planted_passages_are_found_and_others_left(spark, small):
    rng = random.Random(2)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    plain = [f"clean{k} " + " ".join("c%d" % rng.randint(0, 9000) for _ in range(80)) for k in range(40)]
    rows, want = [(k, t, "en", "s", 0) for k, t in enumerate(plain)], set()
    for k, (item, text) in enumerate(items):
        ws = dc.RUN.findall(text)
        for at in rng.sample(range(0, len(ws), 8), len(range(0, len(ws), 8)) // 2):
            ws[at] = "other"
        rows.append((100 + k, f"{plain[k % 40][:200]} {' '.join(ws).upper() if k % 2 else '; '.join(ws)} {plain[k % 40][200:]}", "en", "s", 0))
        want.add((100 + k, item))
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_overlaps(docs, bench).collect()}
    assert want <= got and all(d >= 100 for d, _ in got)
    assert {r["doc_id"] for r in dc.remove(docs, bench).collect()} == {k for k in range(40)}


def test_against_brute_force_on_small_documents(spark, small):
    """Every document that holds an item word for word is found, and nothing else in these tables."""
    norm = lambda t: " " + " ".join(dc.RUN.findall((t or "").lower())) + " "
    docs = [(r["doc_id"], norm(r["text"])) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r["item_id"], norm(r["text"])) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs for i, x in items if x in t}
    assert {(r["doc_id"], r["item_id"]) for r in dc.op9_spaced_seed_decontamination(spark, small).collect()} == want


def test_odd_documents_and_empty_tables(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = odd_documents() + [(70, item, "en", "s", 0), (70, item, "en", "s", 0), (None, item, "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (None, "a b c d e f g h i j k l m n")], "item_id long, text string")
    assert sorted(str(r["doc_id"]) for r in dc.find_overlaps(docs, bench).collect()) == ["70", "70", "None"]
    assert dc.remove(docs, bench).count() == len(rows) - 3
    assert dc.remove(docs, bench.where("false")).count() == len(rows)
    assert dc.find_overlaps(docs.where("false"), bench).count() == 0
    clash = docs.withColumnsRenamed({"lang": "_hits", "source": "_sid"}).selectExpr("*", "'x' AS _text", "1 AS iid", "2 AS seed")
    assert dc.remove(clash, bench).columns == clash.columns
    monkeypatch.setattr(dc, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(dc, "MAX_BITS", 1 << 15)
    assert dc.remove(docs, bench).count() == len(rows) - 3


CONV = "conv_id long, turn long, role string, text string"


def conversations(spark):
    rows = []
    for c in range(12):
        rows += [(c, 0, "user", "same start" if c < 7 else f"own {c}"), (c, 1, "assistant", "yes" if c % 2 else "no"), (c, 2, "user", "and?"), (c, 3, "assistant", f"end {c % 3}")]
    rows += [(20, 0, "user", "alone, no reply"), (21, None, None, None), (21, 1, "assistant", None), (None, 0, "user", "x"), (22, 0, "user", "é"), (22, 1, "assistant", "ü" * 3), (22, 1, "assistant", "ü" * 3), (23, 0, "user", "dup"), (23, 1, "assistant", "a"), (24, 0, "user", "dup"), (24, 1, "assistant", "a")]
    return spark.createDataFrame(rows, CONV), rows


def brute(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "user", x or ""))
    convs = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}
    groups = defaultdict(list)
    for c in sorted(convs):
        groups[convs[c][0]].append(c)
    said = lambda c: sum(len(x) for r, x in convs[c] if r == "assistant")
    pairs = []
    for ids in groups.values():
        for k in range(0, len(ids), 2):
            two = sorted(ids[k : k + 2], key=lambda c: (-said(c), c))
            a = convs[two[0]]
            if len(two) == 2:
                pairs.append((two[0], two[1], a, convs[two[1]]))
            elif any(r == "assistant" for r, _ in a):
                last = max(i for i, (r, _) in enumerate(a) if r == "assistant")
                first = next(x for r, x in a if r == "assistant")
                pairs.append((two[0], None, a, a[:last] + [("assistant", "" if first == a[last][1] else first)]))
    out = []
    for i, j, a, b in pairs:
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        show = lambda ts: "".join(f"<|{r}|>\n{x}{chat.END}" for r, x in ts)

        def spans(ts):
            at, found = 0, []
            for r, x in ts:
                end = at + len(r) + len(x) + 5 + len(chat.END)
                if r == "assistant":
                    found.append((at + len(r) + 5, end))
                at = end
            return found

        out.append((i, j, n, show(a[:n]), show(a[n:]), spans(a[n:]), show(b[n:]), spans(b[n:]), a[n:] != b[n:]))
    return sorted(out, key=str)


def formatted(frame):
    rows = chat.format_preferences(chat.preference_pairs(frame)).collect()
    spans = lambda s: [(x["start"], x["end"]) for x in s]
    return sorted(((r["chosen_id"], r["rejected_id"], r["n_prompt_turns"], r["prompt"], r["chosen"], spans(r["chosen_spans"]), r["rejected"], spans(r["rejected_spans"]), r["differs"]) for r in rows), key=str)


def test_preferences_against_brute_force(spark, small):
    frame, rows = conversations(spark)
    got = formatted(frame)
    assert got == brute(rows)
    for *_, chosen, spans, _, _, _ in got:
        assert all(chosen[a:b].endswith(chat.END) for a, b in spans)
    table = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert formatted(table) == brute([tuple(r) for r in table.collect()])
    assert formatted(frame.where("false")) == []
    clash = frame.selectExpr("*", "'x' AS first", "1 AS place", "'y' AS turns", "'z' AS _bucket", "'c' AS chosen")
    assert formatted(clash) == got
    far = frame.withColumn("conv_id", F.when(F.col("conv_id") == 11, 1 << 62).otherwise(F.col("conv_id")))
    assert len(formatted(far)) == len(got)


def test_op10_digests_are_of_the_formatted_texts(spark, small):
    table = spark.read.parquet(f"{small}/conversations.parquet")
    texts = {r["chosen_id"]: r for r in chat.format_preferences(chat.preference_pairs(table)).collect()}
    for r in chat.op10_preference_format(spark, small).collect():
        t = texts[r["chosen_id"]]
        assert r["prompt_crc32"] == zlib.crc32(t["prompt"].encode()) and r["chosen_crc32"] == zlib.crc32(t["chosen"].encode())
        assert json.dumps(r["chosen_spans"]) == json.dumps(",".join(f"{s['start']}-{s['end']}" for s in t["chosen_spans"]))
