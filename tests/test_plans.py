"""Plans: no pairs without a key, only needed columns read, filters pushed to the scan."""

import pytest

from seriesloom.operators import timejoin
from seriesloom.plans.catalogue import QUERIES

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairs_without_a_key(spark, name):
    text = plan(QUERIES[name](spark, DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_what_is_needed(spark):
    text = plan(QUERIES["asof_backward"](spark, DIR))
    assert "props" not in text
    pushed = [x for x in text.splitlines() if "PushedFilters" in x]
    assert pushed and all("EqualTo(event_type," in x for x in pushed)


def test_an_asof_join_shuffles_rows_once(spark):
    """Without a bucket one exchange; with one, the rows and three exchanges of one row per key and bucket."""
    a, b = (spark.createDataFrame([], "run long, us long, value double") for _ in range(2))
    assert plan(timejoin.asof(a, b, "run", "us", ["value"])).count("Exchange hashpartitioning") == 1
    text = plan(timejoin.asof(a, b, "run", "us", ["value"], bucket=10))
    lines = [x for x in text.splitlines() if "Exchange hashpartitioning" in x]
    assert 2 <= len(lines) <= 4 and text.count("partial_max_by") == 1
