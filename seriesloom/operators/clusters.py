"""Single-link clusters in the plane, from coarse to fine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .sets import components

#: Neighbour cells on one side; those on the other see the same pairs.  Cells are 0.7 of a link wide, so links reach two.
AHEAD = [(du, dv) for du in range(3) for dv in range(-2, 3) if (du, dv) > (0, 0)]

BOX = ["x0", "x1", "y0", "y1", "n", "outer"]

#: Nodes whose trees a task holds before it hands them on.
HELD = 100_000


def _boxes(df: DataFrame, *keys: str) -> DataFrame:
    """The bounds, number of places and least key of each box, and its outermost places in eight directions."""
    place, ways = F.struct("x", "y"), [F.col("x"), F.col("y"), F.col("x") + F.col("y"), F.col("x") - F.col("y")]
    outer = F.array(*(f(place, way) for way in ways for f in (F.min_by, F.max_by))).alias("outer")
    return df.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n"), F.min("_k").alias("c"), outer)


def _apart(a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    return F.sqrt(dx * dx + dy * dy)


def _side(boxes: DataFrame, side: str, *keys: str) -> DataFrame:
    """The group, keys and box of a table, named for one side of a pair."""
    return boxes.select("_g", *(F.col(c).alias(f"{side}_{c}") for c in (*keys, *BOX)))


def _box(side: float, level: Column) -> Column:
    """The box that a place lies in; side is that of a cell, which is of level 0, and exactly halved for each level."""
    wide = F.lit(side) / F.pow(F.lit(2.0), level)
    return F.struct(level.alias("l"), F.floor(F.col("x") / wide).alias("u"), F.floor(F.col("y") / wide).alias("v"))


def _trees(edges: DataFrame, most: int) -> DataFrame:
    """_g, c, cluster, part: each node of a task's edges (_g, a_c, b_c) with the smallest that they join it to, in parts of at most so many nodes and one.

    If no part but 0 has rows, that is all edges say; else what is left to join are the rows as edges.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up, part = {}, TaskContext.get().partitionId() << 32

        def root(a: tuple[int, int]) -> tuple[int, int]:
            while (b := up.setdefault(a, a)) != a:
                up[a] = up[b]
                a = b
            return a

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(*a, root(a)[1], part) for a in up], columns=["_g", "c", "cluster", "part"])

        for d in batches:
            for g, a, b in d.itertuples(index=False, name=None):
                a, b = root((g, a)), root((g, b))
                up[max(a, b)] = min(a, b)
                if len(up) >= most:
                    yield rows()
                    up.clear()
                    part += 1
        if up:
            yield rows()

    return edges.mapInPandas(run, "_g long, c long, cluster long, part long")


def _reach(pairs: DataFrame) -> tuple[Column, Column]:
    """The least and the greatest distance that points of two boxes can have.  Each step rounds monotonically, so that
    these bound the rounded distances of all points within."""
    near, far = [], []
    for c in "xy":
        a0, a1, b0, b1 = (F.col(f"{s}_{c}{e}") for s in "ab" for e in "01")
        near.append(F.greatest(F.lit(0.0), b0 - a1, a0 - b1))
        far.append(F.greatest(b1 - a0, a1 - b0))
    return F.sqrt(near[0] * near[0] + near[1] * near[1]), F.sqrt(far[0] * far[0] + far[1] * far[1])


def linked_in_plane(df: DataFrame, key: str, x: str, y: str, link: float, by: str | None = None, direct: int = 1024) -> DataFrame:
    """(by,) key, cluster: the smallest key among all points that chains of steps of at most `link` reach.

    Points of one cell of 0.7 of a link are linked in any case, so cells are what is clustered, and no cell lists its
    pairs.  Whether two near cells are linked is decided on the bounding boxes of their places (all within reach, or none)
    and on their outermost places; it may stay open.  Boxes with at most `direct` pairs of places are compared place by place, and other open boxes are divided in each
    round, crowded ones into 64: that many boxes meet as there are places, about, and rounds are few, as each of them costs
    the driver some twenty jobs.  A box of one place is never open, so rounds end when boxes are down to single places.
    Links of cells are joined to trees within tasks first; a graph that is more than one task's goes on in rounds.

    Keys are unique integers (within `by`: integers too).  Rows with a null key, group or place, or a place that is not finite, have no row.
    """
    group = F.col(by) if by else F.lit(0)
    finite = lambda c: F.abs(c) < float("inf")  # noqa: E731  null and NaN are not
    p = df.select(group.cast("long").alias("_g"), F.col(key).cast("long").alias("_k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    p = p.where(F.col("_g").isNotNull() & F.col("_k").isNotNull() & finite(F.col("x")) & finite(F.col("y")))
    side = 0.7 * link
    p = cut(p.withColumn("b", _box(side, F.lit(0))))
    # points at one place are one; a cell is named by its group and smallest key
    at = cut(p.groupBy("_g", "b", "x", "y").agg(F.min("_k").alias("_k")))
    cells = cut(_boxes(at, "_g", "b"))
    steps = F.explode(F.array(*(F.struct(F.lit(du).alias("du"), F.lit(dv).alias("dv")) for du, dv in AHEAD)))
    a = _side(cells, "a", "c", "b").withColumn("_d", steps)
    ahead = F.struct(F.lit(0).alias("l"), (F.col("a_b.u") + F.col("_d.du")).alias("u"), (F.col("a_b.v") + F.col("_d.dv")).alias("v"))
    a = a.withColumn("b_b", ahead).drop("_d")
    pairs = a.join(_side(cells, "b", "c", "b"), ["_g", "b_b"])

    touch = F.exists("a_outer", lambda a: F.exists("b_outer", lambda b: _apart(a, b) <= link))
    ends, found = ["_g", "a_c", "b_c"], []
    while True:
        near, far = _reach(pairs)
        pairs = cut(pairs.where(near <= link).select(*ends, "a_b", "b_b", "a_n", "b_n", ((far <= link) | touch).alias("_sure")))
        sure, rest = pairs.where("_sure").select(*ends), pairs.where("not _sure")
        of = lambda s: at.select("_g", F.col("b").alias(f"{s}_b"), F.struct("x", "y").alias(s))  # noqa: B023, E731
        few = rest.where(F.col("a_n") * F.col("b_n") <= direct)
        few = few.join(sure, ends, "left_anti") if found else few
        met = few.join(of("a"), ["_g", "a_b"]).join(of("b"), ["_g", "b_b"])
        hit = cut(sure.unionByName(met.where(_apart(F.col("a"), F.col("b")) <= link).select(*ends)).distinct())
        found.append(hit)
        many = rest.where(F.col("a_n") * F.col("b_n") > direct)
        if many.isEmpty() or (many := cut(many.join(hit, ends, "left_anti"))).isEmpty():
            break
        # a box is divided by its own number of places, whatever it meets
        held = many.select("_g", F.col("a_b").alias("o"), F.col("a_n").alias("n")).union(many.select("_g", "b_b", "b_n")).distinct()
        finer = F.when(F.col("n") > 512, 3).when(F.col("n") > 128, 2).when(F.col("n") > 1, 1).otherwise(0)
        at = cut(at.withColumnRenamed("b", "o").join(held, ["_g", "o"]).withColumn("b", _box(side, F.col("o.l") + finer)).drop("n"))
        boxes = cut(_boxes(at, "_g", "o", "b"))
        open_ = many.select(*ends, F.col("a_b").alias("a_o"), F.col("b_b").alias("b_o"))
        pairs = open_.join(_side(boxes, "a", "o", "b"), ["_g", "a_o"]).join(_side(boxes, "b", "o", "b"), ["_g", "b_o"])
        at = at.drop("o")

    edges = found[0]
    for part in found[1:]:
        edges = edges.unionByName(part)
    labels = cut(_trees(edges.distinct(), HELD))
    if not labels.where("part > 0").isEmpty():
        # keys are unique within a group only, so a node is both
        node = lambda c: F.struct(F.col("_g").alias("g"), F.col(c).alias("c"))
        labels = components(labels.select(node("c").alias("a"), node("cluster").alias("b")))
        labels = labels.select(F.col("node.g").alias("_g"), F.col("node.c").alias("c"), F.col("label.c").alias("cluster"))
    named = cells.select("_g", "b", "c").join(labels.select("_g", "c", "cluster"), ["_g", "c"], "left")
    out = p.join(named.select("_g", "b", F.coalesce("cluster", "c").alias("cluster")), ["_g", "b"])
    kinds = dict(df.dtypes)
    own = [F.col("_g").cast(kinds[by]).alias(by)] if by else []
    return out.select(*own, F.col("_k").cast(kinds[key]).alias(key), "cluster")
