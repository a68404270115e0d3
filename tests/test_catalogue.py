"""Every query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from sluice.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, duck, small, name):
    frame = catalogue.queries()[name](spark, small)
    columns = sorted(frame.columns)
    rows = [tuple(r[c] for c in columns) for r in frame.collect()]
    if name not in catalogue.oracle_sql():
        assert name == "hmac_verify" and [r for r in sorted(rows)] == [(1, True), (2, False), (3, False), (4, True), (5, True)]
        return
    found = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert plain(rows) == plain([tuple(r[i] for i in at) for r in found.fetchall()])
    assert os.path.isdir(os.path.dirname(small))
