"""Raked shares against their targets, and the sample against its rates."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from seriesloom.llm.common import Scratch
from seriesloom.llm.mixing import achieved, mixing_rates, rake, sample_mix


def test_shares_meet_the_targets(spark):
    rows = [(s, l, t, 1 + (7 * i * j * k) % 23) for i, s in enumerate("abc", 1) for j, l in enumerate(["en", "de", None], 1) for k, t in enumerate("xy", 1)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 5, "b": 3, "c": 2}, "lang": {"en": 0.5, "de": 0.4, None: 0.1}, "topic": 0.0}
    got = rake(cells, ["source", "lang", "topic"], targets, Scratch(spark, "t"), 30).collect()
    total = sum(r.tokens for r in rows_of(cells))
    sums = defaultdict(float)
    for r in got:
        for d in ("source", "lang", "topic"):
            sums[d, r[d]] += r.w / total
    want = {("source", "a"): 0.5, ("source", "b"): 0.3, ("source", "c"): 0.2, ("lang", "en"): 0.5, ("lang", "de"): 0.4, ("lang", None): 0.1, ("topic", "x"): 0.5, ("topic", "y"): 0.5}
    assert dict(sums) == pytest.approx(want, abs=1e-6)


def rows_of(df):
    return df.collect()


def test_sample_follows_the_rates(spark):
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("w w w\nw").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(1).alias("tokens"))
    mix = {"source": 0.5, "lang": 1.0, "topic": 1.0}
    rates = mixing_rates(docs, mix, keep=0.4)
    expect, got, n = rates.agg(F.sum("p"), F.sum(F.col("sampled").cast("int")), F.count("*")).first()
    assert n == 8000 and expect == pytest.approx(3200, rel=0.01) and got == pytest.approx(expect, rel=0.05)
    kept = sample_mix(docs, mix, keep=0.4)
    assert kept.columns == docs.columns and kept.count() == got
    assert sample_mix(docs, mix, keep=0.4).exceptAll(kept).count() == 0


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, None, None, None), (1, "", "a", "b"), (1, "", "a", "b")], "doc_id long, text string, source string, lang string")
    assert mixing_rates(docs, {"source": 1.0, "lang": 1.0, "topic": 1.0}, keep=1.0).count() == 3
    assert mixing_rates(docs.limit(0), {"source": 1.0, "lang": 1.0, "topic": 1.0}).count() == 0


def test_a_cell_that_is_used_up_leaves_the_others_to_meet_the_targets(spark):
    """Language b has too few tokens of source y for its rate; the rest of b makes up for it."""
    rows = [(i, "w " * n, s, lang) for i, (s, lang, n) in enumerate([("x", "a", 500), ("x", "b", 300), ("y", "a", 900), ("y", "b", 20)] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("kind", F.lit("k"))
    mix = {"source": {"x": 0.5, "y": 0.5}, "lang": {"b": 0.36, "*": 0.64}, "topic": 1.0}
    got = {(r.dimension, r.value): (r.target, r.share) for r in achieved(docs, mix, 0.5, 24, "kind").collect()}
    assert got.keys() == {("source", "x"), ("source", "y"), ("lang", "a"), ("lang", "b"), ("topic", "k")}
    # cut without raking anew, b would have 0.3505
    assert all(share == pytest.approx(target, abs=0.002) for target, share in got.values())
