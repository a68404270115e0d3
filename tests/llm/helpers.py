"""Rows of odd documents that every operator must handle."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 997}" for k in range(30_000))


def odd_documents() -> list[tuple]:
    texts = [None, "", " ", "\n\n", "one", "one two three", "a  b", " \n a \n \n b ", "Ünïcödé ÀÉ é́ İ.x", "tie tie", "tie tie", LONG, "x" * 5000, "<|endoftext|> is no end", "\0 nul"]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    return [*rows, (3, "\n\n", "en", "s", 2), (None, "no id", None, None, None)]


def write(spark, path, rows, schema=DOCS, name="documents"):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)
