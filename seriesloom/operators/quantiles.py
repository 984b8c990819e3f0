"""Exact order statistics of groups of any size, by rounds of range counts.

A rank is sought in an interval of values.  A round cuts every interval that
holds more than `held` rows into ranges and counts them, an aggregate that
combines on the map side; the range in which the rank falls is the next
interval, from its least to its greatest value.  When an interval is one value,
or few rows, the rank is read off.  So no task holds a group, and the result is
that of sorting it: the same digits as `percentile`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Rows of an interval that are put in order, and ranges of a round.
HELD, RANGES = 10_000, 1024
#: Intervals up to this number are sent to all tasks.
BROADCAST = 50_000


def shares_of(x: str, low: str, high: str, even: bool) -> Column:
    """How far x lies between low and high, from 0 to 1 and never falling as x rises: by the values, or by their logarithms, which tell a long tail apart."""
    # halves before the difference, which may pass the largest double
    plain = (F.col(x) / 2 - F.col(low) / 2) / (F.col(high) / 2 - F.col(low) / 2)
    size = lambda c: F.signum(c) * F.when(F.col(c) == 0, 0.0).otherwise(F.greatest(F.log(F.abs(c)) + 750, F.lit(0.0)))
    wide = size(high) - size(low)
    return plain if even else F.when(wide > 0, (size(x) - size(low)) / wide).otherwise(plain)


def order_statistics(df: DataFrame, by: list[str], value: str, shares: list[float], held: int = HELD, ranges: int = RANGES) -> DataFrame:
    """by, q, x: the interpolated percentiles of value per group, for q in shares; nulls and NaN do not count.

    A null key is a group of its own; a group without values has no row.
    """
    d = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    d = d.withColumn("_g", F.struct(*(F.col(c) for c in by)) if by else F.lit(0)).select("_g", "_v")
    whole = cut(d.groupBy("_g").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    asked = whole.select("_g", "n", F.explode(F.array(*(F.lit(float(q)) for q in shares))).alias("q")).withColumn("_at", F.col("q") * (F.col("n") - 1))
    asked = asked.withColumns({"low": F.floor("_at"), "high": F.ceil("_at")})
    ranks = asked.select("_g", F.explode(F.array("low", "high")).alias("rank")).distinct()
    open_ = cut(ranks.join(whole, "_g").select("_g", "rank", F.lit(0).cast("long").alias("before"), "n", "lo", "hi"))
    known = []

    def rows_in(intervals: DataFrame) -> DataFrame:
        """The rows of each interval (_g, lo, hi); an interval is a few numbers."""
        few = intervals.select("_g", "lo", "hi").distinct()
        few = F.broadcast(few) if few.count() <= BROADCAST else few
        return d.join(few, "_g").where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))

    rounds = 0
    while True:
        one = open_.where("lo = hi")
        known.append(one.select("_g", "rank", F.col("lo").alias("x")))
        small = open_.where((F.col("lo") < F.col("hi")) & (F.col("n") <= held))
        if not small.isEmpty():
            place = F.row_number().over(Window.partitionBy("_g", "lo", "hi").orderBy("_v")) - 1
            found = rows_in(small).withColumn("_place", place).join(small.withColumn("_place", F.col("rank") - F.col("before")), ["_g", "lo", "hi", "_place"])
            known.append(cut(found.select("_g", "rank", F.col("_v").alias("x"))))
        wide = open_.where((F.col("lo") < F.col("hi")) & (F.col("n") > held))
        if wide.isEmpty():
            break
        share = shares_of("_v", "lo", "hi", rounds % 2 == 0)
        rounds += 1
        binned = rows_in(wide).withColumn("_bin", F.least(F.floor(share * ranges), F.lit(ranges - 1)))
        counts = binned.groupBy("_g", "lo", "hi", "_bin").agg(F.count("*").alias("c"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        up = Window.partitionBy("_g", "lo", "hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("skipped", F.coalesce(F.sum("c").over(up), F.lit(0)))
        within = F.col("rank") - F.col("before")
        next_ = wide.drop("n").join(counts, ["_g", "lo", "hi"]).where((within >= F.col("skipped")) & (within < F.col("skipped") + F.col("c")))
        open_ = cut(next_.select("_g", "rank", (F.col("before") + F.col("skipped")).alias("before"), F.col("c").alias("n"), F.col("least").alias("lo"), F.col("most").alias("hi")))
    values = known[0]
    for k in known[1:]:
        values = values.unionByName(k)
    values = cut(values)
    named = lambda rank, x: values.select("_g", F.col("rank").alias(rank), F.col("x").alias(x))
    got = asked.join(named("low", "_a"), ["_g", "low"]).join(named("high", "_b"), ["_g", "high"])
    x = F.when(F.col("low") == F.col("high"), F.col("_a")).otherwise((F.col("high") - F.col("_at")) * F.col("_a") + (F.col("_at") - F.col("low")) * F.col("_b"))
    return got.select(*(F.col("_g")[c].alias(c) for c in by), "q", x.alias("x"))


def side_by_side(found: DataFrame, by: list[str], names: dict[float, str]) -> DataFrame:
    """by and a column for each named share."""
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("q") == q, F.col("x"))).alias(n) for q, n in names.items()))
