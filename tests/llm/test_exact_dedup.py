"""Exact dedup against a dictionary, over several tree depths and on edge cases."""

import hashlib
import re

import pytest

from featspark.llm import exact_dedup


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        t = re.sub("[\x20\x09-\x0d]+", " ", text or "")
        groups.setdefault(t, []).append(doc_id)
    return groups


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (1, None), (2, ""), (None, ""), (7, "x" * 50000), (7, "x" * 50000), (4, "x" * 50000), (8, "\n"), (6, " "), (None, "only"), (10, "a\x1cb")]


@pytest.mark.parametrize("rounds", [1, 3])
def test_against_dictionary(spark, rounds):
    docs = spark.createDataFrame([(d, t, "s", True, 1) for d, t in ROWS], "doc_id long, text string, sha string, kept boolean, node int").repartition(4)
    got = exact_dedup.exact_duplicates(docs, rounds).collect()
    groups = brute(ROWS)
    assert len(got) == len(ROWS)
    for t, ids in groups.items():
        mine = [r for r in got if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]
        smallest = min([i for i in ids if i is not None], default=None)
        assert len(mine) == len(ids) and {r.group_size for r in mine} == {len(ids)} and {r.keep_id for r in mine} == {smallest}
        assert [r.doc_id for r in mine if r.kept] == [smallest]
    kept = exact_dedup.drop_exact_duplicates(docs, rounds)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_empty_and_many_batches(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_duplicates(none).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        docs = spark.range(500).selectExpr("id as doc_id", "concat('t', id % 13) as text")
        got = exact_dedup.exact_duplicates(docs, 2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(r.keep_id == r.doc_id % 13 and r.kept == (r.doc_id < 13) for r in got) and len(got) == 500
