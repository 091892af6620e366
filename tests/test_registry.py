import os

import pytest

import __spark_entry__ as entry_points

SMALL = "/root/testdata/sf0.001"


def test_every_check_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert len(entry_points.queries()) > 120


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_entry(spark):
    frame = entry_points.entry(spark)
    assert frame.columns == ["repo", "n_ai", "merge_rate_ai", "n_human", "merge_rate_human"] and frame.count() > 1


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["AGG1_merge_status", "AGG11_pr_length", "WIN1_author_history", "DET4_commit_evidence", "PAR1_merge_decision", "SMP3_rounds"])
def test_queries_equal_their_sql(spark, name):
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(entry_points.__file__), "tools"))
    from check_queries import compare, connect

    verdict, note = compare(connect(SMALL), entry_points.queries()[name](spark, SMALL), entry_points.oracle_sql()[name])
    assert verdict == "ok", note
