"""Queries that do the whole of a job, against their SQL and with hits."""

import os
from collections import Counter

import duckdb
import pytest
from test_queries import DATA, plain

from acervo import catalog

LARGER = "/root/testdata/sf0.1"  # the smallest tables have no glyph references and no label often enough
pytestmark = pytest.mark.skipif(not (os.path.isdir(DATA) and os.path.isdir(LARGER)), reason="no test tables")


def same_as_sql(spark, name, data=DATA):
    """The rows of a query, after they have been found equal to those of its SQL."""
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    df, want = catalog.QUERIES[name](spark, data), con.sql(catalog.ORACLE_SQL[name])
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)
    return [dict(zip(cols, r)) for r in got]


@pytest.mark.parametrize("name", ["acute_repair_originals", "hyphens_joined_originals"])
def test_texts_of_scans_are_repaired(spark, name):
    assert len(same_as_sql(spark, name)) > 0


def test_texts_of_scans_are_scored(spark):
    assert any(r["score"] not in (None, 1) and r["score"] > 0 for r in same_as_sql(spark, "extraction_scores_originals", LARGER))


def test_whole_answers_are_read_back(spark):
    assert any(len(r["answer"] or "") > 40 and "\n" in r["answer"] for r in same_as_sql(spark, "answers_after_marker"))


def test_limits_of_the_reference(spark):
    assert max(Counter(r["doc_type"] for r in same_as_sql(spark, "balanced_records")).values()) > 50
    assert max(len((r["head"] or "").split(" ")) for r in same_as_sql(spark, "first_tokens")) > 50
    assert max(Counter(r["subject"] for r in same_as_sql(spark, "capped_label_sample", LARGER)).values()) > 20
