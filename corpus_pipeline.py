"""A training corpus from raw documents: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
documents; the last returns the packed pieces.

A filtering stage's result reads its docs and at most two small tables of the ids of rows to drop or
to keep once; it has deleted everything else that it wrote on the way. So results may be used late,
in any order, and in several threads: a stage never touches what another one needs. `run`
deletes those small tables, and the docs of a stage, when the stage's result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import decontaminate, jaccard, packing, quality_classifier, quality_rules
from sluice.llm.common import discard, save, table, tables_made

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("quality_classifier", quality_classifier.stage),
    ("near_duplicates", jaccard.stage),
    ("decontamination", decontaminate.stage),
    ("packing", packing.stage),
]

#: The fitted scorer and the tokenizer have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with tables_made() as made:
            out = stage(spark, docs, sf_dir)
        kept = save(out, name)
        discard(*made, *([docs] if k else []))
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
