"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, each_slice, slice_mask, spread_key


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """node, label for every node of edges (u, v: long); label is the smallest node reachable.

    Alternates large-star and small-star steps, each an aggregate and a join on
    a node, until the edges are stars; the edges of one node are spread over
    slices where they are joined.  Every round is written, so lineage stays
    short.  Nothing but two numbers a round reaches the driver.  A loop is no
    edge; an edge with a null end is none.
    """
    up = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e, seen, i = scratch.keep(up(edges), f"{tag}-0"), None, 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("s", spread_key("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), slice_mask("s").alias("mask"))
        large = up(both.where("v > u").join(least.select("u", "m", each_slice("mask").alias("s")), ["u", "s"]).select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = large.withColumn("s", spread_key("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"), slice_mask("s").alias("mask"))
        small = large.join(least.select("u", "m", each_slice("mask").alias("s")), ["u", "s"]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        i += 1
        e = scratch.keep(up(small), f"{tag}-{i}")
        scratch.drop(f"{tag}-{i - 1}")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
