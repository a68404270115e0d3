import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import quality_classifier as qc
from sluice.llm import quality_rules as qr

from .helpers import DOCS, odd_documents, write

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    ws, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 5))
    failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed


def bad_line(line):
    ws, n = WORD.findall(line), len(line)
    count = lambda chars: sum(line.count(c) for c in chars)
    if count(qr.SIGNS) * 100 > n * 15 or n >= 12 and count(qr.CAPITALS) * 100 > (n - count(qr.SPACES)) * 60:
        return True
    if any(p in line.lower() for p in qr.PHRASES) or sum(a == b for a, b in zip(ws, ws[1:], strict=False)) * 100 > len(ws) * 30:
        return True
    bars = count(qr.SEPARATORS)
    return bars >= 2 and bars * 4 >= len(ws)


def cleaned(text):
    seen, out = set(), []
    for line in (text or "").split("\n"):
        if WORD.search(line):
            if line in seen or bad_line(line):
                seen.add(line)
                continue
            seen.add(line)
        out.append(line)
    return "\n".join(out)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def check(rows, frame):
    want = Counter()
    for d, t, *_ in rows:
        m, text = measures(t), cleaned(t)
        want[(d, *m, not m[5] and len(WORD.findall(text)) >= 0.5 * m[0], text)] += 1
    assert Counter(tuple(r[c] for c in ["doc_id", *NAMES, "kept", "clean_text"]) for r in frame.collect()) == want


def test_rules_on_small_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check([tuple(r) for r in docs.collect()], qr.clean(docs))


def test_rules_on_odd_documents(spark, tmp_path):
    extra = ["menu | home | shop | help\nA line that stays here, with ten words in it, surely.\nA line that stays here, with ten words in it, surely.", "a b c d e " * 300, "w\x0bx\x0cy\rz " * 10, "Tous Droits Réservés 2020\nLea la política de privacidad\nCAPITALS ONLY IN THIS LINE\nGood words follow after it, so that enough of the text is left over."]
    rows = odd_documents() + [(100 + k, t, "en", "s", 0) for k, t in enumerate(extra)]
    check(rows, qr.clean(spark.createDataFrame(rows, DOCS).withColumnsRenamed({"lang": "kept", "source": "clean_text"})))
    empty = write(spark, tmp_path / "e", [])
    assert qr.op5_quality_rules(spark, empty).count() == 0
    staged = qr.stage(spark, spark.createDataFrame(rows, DOCS), empty)
    assert staged.columns == ["doc_id", "text", "lang", "source", "n_chars"] and all(len(r["text"]) == r["n_chars"] for r in staged.collect())


def test_long_texts_with_repeated_lines_take_n_log_n(spark):
    """A text with every line twice: four times the lines take far less than sixteen times as long."""
    took = []
    for n in (10_000, 10_000, 40_000):
        text = "\n".join(f"Line {k % (n // 2)} of a text with words enough, so that it is no bad line." for k in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        row = qr.clean(docs).first()
        took.append(time.time() - began)
        assert row["n_dup_lines"] == n // 2 and row["clean_text"].count("\n") == n // 2 - 1
    assert took[2] < 10 * took[1] + 2


def labelled(spark, sf):
    return {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}


def test_rules_and_classifier_against_held_out_labels(spark):
    """No label is used in fitting, so all of them are held out."""
    sf = "/root/testdata/sf0.01"
    quality = labelled(spark, sf)
    rules = {r["doc_id"]: r for r in qr.op5_quality_rules(spark, sf).collect()}
    judged = [(q, rules[d]["kept"]) for d, q in quality.items() if not rules[d]["base_failed"]]
    assert sum(q == k for q, k in judged) >= 0.98 * len(judged)
    scores = {r["doc_id"]: r for r in qc.op7_quality_classifier(spark, sf).collect()}
    assert sum(q == scores[d]["kept"] for d, q in quality.items()) >= 0.97 * len(quality)


def test_em_finds_the_labellers_accuracies():
    rng, counts = np.random.default_rng(1), Counter()
    true_bad = np.array([0.7 if bad else 0.0 for _, _, bad, _ in qc.LABELLERS])
    true_good = np.array([0.8 if good else 0.0 for _, _, _, good in qc.LABELLERS])
    for _ in range(20_000):
        good = rng.random() < 0.8
        u = rng.random(len(qc.LABELLERS))
        counts["".join(("g" if x < g else "b" if x < g + 0.02 * (b > 0) else "-") if good else ("b" if x < b else "g" if x < b + 0.05 * (g > 0) else "-") for x, b, g in zip(u, true_bad, true_good, strict=True))] += 1
    model = qc.expectation_maximisation(counts)
    assert model.good == pytest.approx(0.8, abs=0.02)
    assert np.abs(model.chances[:, 0, 0] - true_bad).max() < 0.05 and np.abs(model.chances[:, 1, 1] - true_good).max() < 0.05


def test_classifier_on_odd_documents(spark, tmp_path):
    rows = odd_documents()
    got = qc.op7_quality_classifier(spark, write(spark, tmp_path / "o", rows)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert all(0 <= r["p_good"] <= 1 for r in got)
    assert qc.op7_quality_classifier(spark, write(spark, tmp_path / "e", [])).count() == 0
    staged = qc.stage(spark, spark.createDataFrame(rows, DOCS), "")
    assert staged.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def plain_signals(text):
    """Shares, vote pattern and features of one text, word by word."""
    lines, ws = [x for x in (text or "").encode().split(b"\n") if x.split()], (text or "").encode().split()
    shares, n = dict.fromkeys(qc.SHARES, 0.0), len(ws)
    decoded = [w.decode() for w in ws]
    if n:
        windows = [tuple(ws[i : i + 5]) for i in range(n - 4)]
        shares |= {
            "plain": sum(qc.PLAIN.fullmatch(w) is not None for w in decoded) / n, "capital": sum(w.isupper() and len(w) > 1 for w in decoded) / n,
            "separator": sum(any(c in w for c in "|»·") for w in decoded) / n, "adjacent": sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / n,
            "window": 1 - len(set(windows)) / len(windows) if windows else 0.0, "dup_lines": 1 - len(set(lines)) / len(lines),
            "sentence": sum(x.decode().split()[-1][-1] in ".!?…" and x.decode().split()[0][0].isupper() and qc.PLAIN.fullmatch(x.decode().split()[0]) is not None for x in lines) / len(lines),
        }
    pattern = ""
    for _, share, bad, good in qc.LABELLERS:
        x = shares[share]
        hit = lambda rule, x=x: rule is not None and (x < rule[1] if rule[0] == "<" else x > rule[1])
        pattern += "b" if not n or hit(bad) else "g" if hit(good) else "-"
    shapes = [zlib.crc32(s.encode()) for w in decoded for s in qc.shapes_of(w)]
    features = Counter(s % qc.DIM for s in shapes) + Counter((a * 31 + b * 17 + 7) % qc.DIM for a, b in zip(shapes, shapes[1:], strict=False))
    return shares, pattern, features, len(shapes)


def plain_score(text, w):
    shares, _, features, n = plain_signals(text)
    total = sum(w[i] * c / max(1, n) for i, c in features.items()) + sum(0.3 * w[zlib.crc32(f"{k}={min(9, int(shares[k] * 10))}".encode()) % qc.DIM] for k in qc.SHARES) + w[-1]
    return 1 / (1 + math.exp(-min(30, max(-30, total))))


def test_signals_and_scores_against_brute_force(spark, small):
    # Words as Python splits them: bytes and text differ in signs like \x1c and \x85, which the small table has not.
    odd = [r for r in odd_documents() if not any(c in (r[1] or "") for c in "\x00\x85\xa0")]
    rows = [tuple(r)[:2] for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [(10**6 + k, r[1]) for k, r in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    frame = qc.save(qc.with_features(docs, "f", ["doc_id"]), "f")
    for r in frame.collect():
        _, pattern, features, n = plain_signals(texts[r["doc_id"]])
        assert (r["f"]["pattern"], dict(zip(r["f"]["index"], r["f"]["count"], strict=True)), r["f"]["n_shapes"]) == (pattern, dict(features), n)
    model, w = qc.fit(frame.select("f.*"))
    assert 0.5 < model.good < 1
    for r in qc.with_scores(frame, "f", w, "p").collect():
        assert r["p"] == pytest.approx(plain_score(texts[r["doc_id"]], w), abs=1e-6)


def test_sample_is_bounded_in_rows_and_clashing_names_are_kept(spark, monkeypatch):
    rows = [(7, "one two three four five six.")] * 3000 + [(k, f"Plain words stand here, and number {k} too.") for k in range(500)] + [(None, "| | |")] * 300
    seen = []
    monkeypatch.setattr(qc, "train", lambda found: seen.append(len(found)) or np.append(np.zeros(qc.DIM), 5.0))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("p_good", "_p_good", "_features", "label", "pattern", "pick", "_source")})
    staged = qc.fitted_scores(docs, "p", docs.columns, sample_rows=200)
    assert staged.columns == [*docs.columns, "p"] and staged.where("p_good = 'mine' AND _features = 'mine'").count() == len(rows)
    assert qc.stage(spark, docs, "").columns == docs.columns
    assert seen[0] <= 200


def test_features_cover_the_whole_of_a_long_word():
    base = "".join(chr(0x4E00 + k) for k in range(200))
    assert "".join(qc.shapes_of(base)) == base and qc.shapes_of("Word9-word") == ["a0-a"]
    at = lambda text: set(qc.read_batch([text.encode()], qc.Shapes()).index.tolist())
    assert at(base) != at(base[:150] + base[:50]) and len(at(base)) > 30
    assert len(at("Q+/" * 50_000)) > 1
