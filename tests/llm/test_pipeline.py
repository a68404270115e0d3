"""Every stage against brute force on what the one before kept, and run() against the stages."""

from collections import Counter

import corpus_pipeline
from sluice.llm import decontaminate as dc

from .test_jaccard import truth
from .test_quality import WORD, cleaned, measures
from .test_tokens_packing import check_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_run(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        out.write.parquet(f"{tmp_path}/{k}")
        back = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert back.columns == COLUMNS
            kept[name] = {r["doc_id"]: r["text"] for r in back.collect()}
        docs, last = back, back
    passed = {}
    for d, r in rows.items():
        m, text = measures(r["text"]), cleaned(r["text"])
        if not m[5] and len(WORD.findall(text)) >= 0.5 * m[0]:
            passed[d] = text
    assert kept["quality_rules"] == passed
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert all(quality.get(d, 1) == 1 for d in kept["quality_classifier"])
    lost = set(passed) - set(kept["quality_classifier"])
    assert not any(quality.get(d) == 1 for d in lost) and len(lost) <= 0.02 * len(passed)
    groups = truth(list(kept["quality_classifier"].items()), 5, 80, 100)
    assert set(kept["near_duplicates"]) == {d for d, (_, c) in groups.items() if c == d}
    items = [" " + " ".join(dc.RUN.findall(r["text"].lower())) + " " for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = {d for d, t in kept["near_duplicates"].items() if not any(i in " " + " ".join(dc.RUN.findall(t.lower())) + " " for i in items)}
    assert set(kept["decontamination"]) == clean
    check_packing([(d, t) for d, t in kept["decontamination"].items()], last.collect(), 1024)
    key = lambda frame: Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in frame.collect())
    assert key(corpus_pipeline.run(spark, small)) == key(last)


def test_odd_rows_and_no_rows(spark, small):
    from .helpers import DOCS, odd_documents

    rows = [*odd_documents(), (60, "A plain text of more than ten words stands here, and it is kept by the rules.", "en", "s", 80)]
    rows += [(k, f"A plain text of more than ten words stands here, number {k} of its kind, and stays.", None, None, None) for k in range(61, 90)]
    for docs in (spark.createDataFrame(rows, DOCS), spark.createDataFrame([], DOCS)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = corpus_pipeline.save(stage(spark, docs, small), name)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == COLUMNS, name
        assert {"doc_id", "piece", "sequence_id", "offset"} <= set(docs.columns)


def test_lazy_inputs_repeated_ids_and_clashing_columns(spark, small):
    """Stages fed with results that are not written, on two corpora in turn; ids that repeat; extra columns."""
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id % 60 AS doc_id", "text", "lang", "source", "n_chars", "1 AS h", "'x' AS _h", "2 AS _g_doc", "3 AS kept", "4 AS p")
    first, second = docs.where("n_chars % 2 = 0"), docs.where("n_chars % 2 = 1")
    out = []
    for corpus in (first, second):
        for name, stage in corpus_pipeline.STAGES[:3]:
            corpus = stage(spark, corpus, small)
            assert set(corpus.columns) <= set(docs.columns), name
        out.append(corpus)
    again = []
    for corpus in (first, second):
        for name, stage in corpus_pipeline.STAGES[:3]:
            corpus = corpus_pipeline.save(stage(spark, corpus, small), name)
        again.append(corpus)
    key = lambda frame: Counter((r["doc_id"], r["text"]) for r in frame.collect())
    assert [key(x) for x in out] == [key(x) for x in again] and all(key(x) for x in out)
    rest = corpus_pipeline.STAGES[3][1](spark, out[0], small)
    assert set(key(rest)) <= set(key(out[0]))
    corpus_pipeline.STAGES[4][1](spark, rest, small).write.format("noop").mode("overwrite").save()


def test_run_leaves_no_large_tables(spark, small, tmp_path, monkeypatch):
    import os

    from sluice.llm import common

    monkeypatch.setitem(common._OWN, spark.sparkContext.applicationId, f"file://{tmp_path}")
    corpus_pipeline.run(spark, small).count()
    left = {d.rsplit("-", 1)[0] for d in os.listdir(tmp_path)}
    assert left <= {"decontamination", "pieces", "ranges"}, left
