"""The run audit on a recording known by hand, in any buckets."""

import pytest

from seriesloom.operators import audit

SHAPE = "run long, topic string, seq long, tb long, th long, value double"
S = 1_000_000


def recording():
    rows = [(1, "a", k, 100 * S + k * S // 2, 100 * S + k * S // 2 - S // 10, float(k % 3)) for k in range(20)]
    rows[12] = (1, "a", 12, 106 * S, 107 * S, None)  # a stamp from the future
    rows[15] = (1, "a", 15, 107 * S + S // 2, 0, -4.0)  # none
    rows += [(1, "b", 100 + k, 101 * S + 3 * k * S, 100 * S + 9 * S // 10 + 3 * k * S, float("nan") if k == 1 else 2.0) for k in range(3)]
    rows += [(1, "b", 103, 107 * S, 106 * S + 9 * S // 10, 2.0)]  # again at the same time
    rows += [(2, "other", 1, 5, 5, 1.0), (None, "a", 1, 5, 5, 1.0), (3, None, 1, 5, 5, 1.0), (4, "a", 1, None, 5, 1.0)]
    return rows


@pytest.fixture(scope="module", params=[S, 10**12])
def found(spark, request):
    d = spark.createDataFrame(recording(), SHAPE)
    return {r.run: r for r in audit.run_audit(d, ["a", "b"], ["a"], bucket=request.param).collect()}


def test_whole_run(found):
    r = found[1]
    assert (r.start, r.seconds, r.rows, r.topics, r.complete) == (100 * S, 9.5, 24, 2, True)
    assert set(found) == {1, 2} and (found[2].topics, found[2].complete, found[2].n_a, found[2].late_mid) == (1, False, None, None)


def test_topics(found):
    r = found[1]
    assert (r.n_a, r.n_b, r.first_s_a, r.first_s_b, r.tail_s_b) == (20, 4, 0.0, 1.0, 2.5)
    assert (r.rate_a, r.max_gap_s_a, r.gaps_a, r.gaps_b, r.long_gaps_b, r.dropped_s_b, r.arrival_dup_b, r.dup_b) == (2.0, 0.5, 0, 2, 2, 6.0, 1, 1)
    assert (r.zero_a, r.back_a, r.all_back, r.off_med_s_a, r.off_min_s_a) == (1, 2, 2, 0.1, -1.0)
    assert (r.ahead_a, r.behind_a, r.glitch_first_s_a, round(r.glitch_most_s_a, 9)) == (1, 0, 6.0, 1.1)
    assert (r.nulls_a, r.nulls_b, r.neg_a, r.least_a, r.most_a, r.begins_a) == (1, 1, 1, -4.0, 2.0, 0.0)


def test_order(found):
    r = found[1]
    # the clock leaps from 105.4 to the stamp ahead, 107; two rows come behind it, and one without a stamp; the next is at 107.9
    assert (r.late_start, r.late_mid, r.leaps, r.leap_s) == (0, 3, 2, 1.6)
    assert (r.most_in_3_s, r.moving_in_3_s) == (2.0, True)


def test_nothing(spark):
    assert audit.run_audit(spark.createDataFrame([], SHAPE), ["a"], ["a"]).count() == 0
