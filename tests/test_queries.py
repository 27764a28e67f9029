"""Queries against their SQL on the smallest tables, where those tables are at hand."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from acervo import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SAMPLE = ["f1_by_field", "list_match_by_field", "curated_export", "stratified_split", "cid_filter_counts", "text_normalised_roman", "tfidf_terms", "tagged_runs", "histogram_valleys", "salvaged_pairs", "centroid_classes", "nearest_neighbours"]


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return None if math.isnan(float(v)) else float(f"{float(v):.9g}")
    return v


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df, want = catalog.QUERIES[name](spark, DATA), con.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
