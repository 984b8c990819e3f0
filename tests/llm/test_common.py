"""Hashes of ranges, words, slices and scratch tables."""

import os

import numpy as np

from seriesloom.llm import common


def test_hashes_of_equal_bytes_are_equal():
    buf = np.frombuffer(b"abcabcab" * 9, np.uint8)
    h = common.RangeHash(buf)
    a = np.arange(60)
    one = h(a, a + 5)
    assert (one == h.rolling(5)[:60]).all()
    assert len(set(one.tolist())) == len({bytes(buf[i : i + 5]) for i in a})
    assert h(np.array([0]), np.array([3]))[0] != h(np.array([0]), np.array([4]))[0]


def test_words_and_slices():
    start, end = common.word_bounds(np.frombuffer(b"  ab\tc\n", np.uint8))
    assert list(zip(start, end)) == [(2, 4), (5, 6)]
    assert list(common.slices([3, 3, 9, 1, 1], 6)) == [(0, 2), (2, 3), (3, 5)]
    assert list(common.slices([], 6)) == []


def test_scratch_is_removed(spark):
    s = common.Scratch(spark, "t")
    assert s.keep(spark.range(3), "a").count() == 3 and os.path.exists(s.path("a").removeprefix("file://"))
    s.drop("a")
    assert not os.path.exists(s.path("a").removeprefix("file://"))
    s.keep(spark.range(3), "b")
    common.clear(spark)
    assert not os.path.exists(s.root.removeprefix("file://"))
