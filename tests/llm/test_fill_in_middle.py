import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sluice.llm import fill_in_middle as fim

from .helpers import DOCS, odd_documents, write

SEE = "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256".split()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    found = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    d = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(found)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(found[:a]), "".join(found[a:b]), "".join(found[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def odd():
    more = ["😀a😀😀bćd", "𝒳𝒴 z", "a<S>b", "<P", "P><S", "<<<S", "M>a<", "\n", "a\r\nb\x85c d", "é", "aé", "Ａb", "İK", "<M>"]
    return odd_documents() + [(100 + k * 37 + i, t, "en", "s", 0) for i, t in enumerate(more) for k in range(12)]


def test_odd_texts_against_brute_force(spark, tmp_path):
    rows = odd()
    got = fim.op12_fill_in_middle(spark, write(spark, tmp_path, rows))
    assert got.columns == SEE
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(brute(d, t)) for d, t, *_ in rows)
    none = write(spark, tmp_path / "none", [])
    assert fim.op12_fill_in_middle(spark, none).collect() == []


def test_documents_against_brute_force_and_sql(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in fim.op12_fill_in_middle(spark, small).select(SEE).collect())
    assert got == sorted(brute(*r) for r in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert sorted(tuple(r) for r in duckdb.sql(f"SELECT {', '.join(SEE)} FROM ({fim.OP12_SQL})").fetchall()) == got


GRAMMAR = {"letters": "[A-Za-z]+|[^A-Za-z]", "characters": r"[\s\S]", "words": r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", "lines": r"[^\n]*\n|[^\n]+"}


@pytest.mark.parametrize("name", sorted(fim.GRAMMARS))
def test_units_of_each_grammar(spark, tmp_path, name):
    rows = [(k, t) for k, (_, t, *_) in enumerate(odd())]
    frame = spark.createDataFrame(rows, "k long, text string").withColumn("u", fim.units(F.col("text"), fim.GRAMMARS[name]))
    for r in frame.collect():
        assert r["u"] == re.findall(GRAMMAR[name], r["text"] or ""), r["k"]


def test_own_sentinels_shares_and_clashing_columns(spark):
    rows = [(k, f"word{k} <P> and more", 7, "x") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, Output string")
    for bad in (("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("", "x", "y")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, sentinels=bad)
    marks = ("\u0001p", "\u0001s", "\u0001m")
    out = fim.fill_in_middle(docs, "words", 5, plain_percent=0, spm_percent=50, sentinels=marks)
    assert out.columns == ["doc_id", "text", *fim.NEW]
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r["form"] for r in got} == {"psm", "spm"} and all(r["back"] == r["text"] == r["prefix"] + r["middle"] + r["suffix"] for r in got)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
