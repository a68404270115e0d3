import random
import re

import duckdb
import pytest

from sluice.llm import license_scan as lic

from .helpers import odd_documents, write

SEE = "doc_id n_words n_base first_word last_word base_labels labels score".split()
A_TO_Z = {k: k + 32 for k in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z))


def brute(doc_id, text, base=lic.BASE, templates=lic.TEMPLATES, percent=90):
    ws = words(text)
    places = [(i, label) for phrase, label in base for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    own, found, best = {x for _, x in places}, set(), 0.0
    for label, t in templates:
        n, wanted = len(words(t)), set(words(t))
        w = 1
        while w < n:
            w *= 2
        for start in range(0, max(1, len(ws)), w):
            shared = len(wanted & set(ws[start : start + 2 * w]))
            if shared * 100 >= percent * len(wanted):
                found.add(label)
                best = max(best, shared / len(wanted))
    starts = [i for i, _ in places]
    return doc_id, len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | found)), 1.0 if own else best


def planted():
    rng, rows = random.Random(11), []
    for k, (_, text) in enumerate(lic.TEMPLATES * 4):
        ws = text.split()
        for _ in range(k % 3):
            ws[rng.randrange(len(ws))] = rng.choice(["of", "the", "zzz", "license"])
        before = " ".join(rng.choice(["lorem", "the", "under", "license", "of"]) for _ in range(rng.randrange(90)))
        rows.append((1000 + k, before + rng.choice([" ", "\n", ". "]) + rng.choice([" ", "\n", "-"]).join(ws) + " tail" * rng.randrange(9)))
    rows += [(2000, "cc by cc by CC-BY all all rights reserved"), (2001, "general public licenses"), (2002, "general public license"), (2003, "mit license the released under"), (2004, "publİc KIT Kc by"), (2005, "cc"), (None, "Released under the MIT License."), (None, "Released under the MIT License.")]
    return rows


def test_planted_and_odd_texts(spark, tmp_path):
    rows = [r[:2] for r in odd_documents()] + planted()
    path = write(spark, tmp_path, [(*r, "en", "s", 0) for r in rows])
    got = lic.op11_license_scan(spark, path)
    assert got.columns == SEE
    want = sorted(repr(brute(*r)) for r in rows)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    assert sum("mit" in w for w in want) > 5
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    assert sorted(repr(tuple(r)) for r in duckdb.sql(f"SELECT {', '.join(SEE)} FROM ({lic.OP11_SQL})").fetchall()) == want
    assert lic.op11_license_scan(spark, write(spark, tmp_path / "none", [])).collect() == []


def test_documents_against_brute_force_without_python(spark, small):
    frame = lic.op11_license_scan(spark, small)
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(repr(tuple(r)) for r in frame.collect()) == sorted(repr(brute(*r)) for r in rows)
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("percent", [50, 75, 100])
def test_filters_lose_nothing(spark, percent):
    rng = random.Random(percent)
    vocabulary = [f"w{k}" for k in range(14)]
    templates = [(f"t{k}", " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 12)))) for k in range(9)] + [("none", "...")]
    rows = [(k, " ".join(rng.choice([*vocabulary, "x", "y"]) for _ in range(rng.randrange(60)))) for k in range(150)]
    frame = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, score int, _rid string")
    got = lic.scan(frame, [("w1 w1", "b"), ("w2", "a")], templates, percent)
    assert got.columns == ["doc_id", "text", "_rid", *lic.NEW]
    for r in got.collect():
        want = brute(r["doc_id"], r["text"], [("w1 w1", "b"), ("w2", "a")], templates[:-1], percent)
        assert (r["n_base"], ",".join(r["base_labels"]), ",".join(r["labels"]), r["score"]) == (want[2], want[5], want[6], want[7])
        assert {m["label"] for m in r["matches"]} | set(r["base_labels"]) == set(r["labels"])
