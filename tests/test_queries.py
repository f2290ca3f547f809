"""Registered queries against the same query in SQL, at the smallest scale; all names are well formed."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, norm

SF = "/root/testdata/sf0.001"
PICK = ["A1_feature_stats", "A3_describe", "Q20_classify_transitions", "Q1_pearson", "Q3_mutual_info", "W2_runs", "W20_assign_split", "A29_apc", "J4_contacts", "G4_dbscan", "B5_conservation_corr", "Q36_pattern_novelty"]


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 200 and set(o) <= set(q) and set(PICK) <= set(o)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "score" in df.columns


@pytest.mark.parametrize("name", PICK)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)
