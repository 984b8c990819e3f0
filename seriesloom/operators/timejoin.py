"""Joins of keyed series on time: as-of, nearest, interpolating, band and response joins.

All of them but the band join shuffle the rows once, on the key: both series
are laid into one, and windows carry the neighbours of the other side.  No
pairs arise.  With `bucket`, the rows are shuffled once on the key and a time
bucket, so that a long run is not one task, and what a bucket inherits from
others is joined in from a table of one row per key and bucket.  The result
does not depend on the bucket.

A row whose key or time is null meets nothing: a left one stays without a
match, a right one is no match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def around(left: DataFrame, right: DataFrame, by: str, on: str, values: list[str], tie: str | None = None, bucket: int | None = None) -> DataFrame:
    """left with prev and next: structs (on, values) of the last right row at or before it and the first after it.

    Of right rows with equal times the one with the greatest tie counts.
    """
    seen = F.struct(on, *values)
    none = F.lit(None).cast(right.select(seen.alias("x")).schema["x"].dataType)
    a = left.withColumns({"_right": none, "_side": F.lit(1), "_tie": F.lit(None).cast("long")})
    b = right.where(F.col(by).isNotNull() & F.col(on).isNotNull()).select(by, on, seen.alias("_right"), F.lit(0).alias("_side"), (F.col(tie) if tie else F.lit(None)).cast("long").alias("_tie"))
    both = a.unionByName(b, allowMissingColumns=True)
    keys = [by]
    if bucket:
        both = both.withColumn("_bucket", F.floor(F.col(on) / bucket))
        keys.append("_bucket")
    # a frame that looks ahead is a frame that looks back in descending order
    back = Window.partitionBy(*keys).orderBy(on, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc(on), F.desc("_side"), F.desc("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("prev", F.last("_right", True).over(back)).withColumn("next", F.last("_right", True).over(ahead))
    if bucket:
        # max_by and min_by pass over rows without an order: those of the left side
        own = lambda tie: F.when(F.col("_side") == 0, F.struct(on, tie))
        ends = both.where(F.col(by).isNotNull() & F.col("_bucket").isNotNull()).groupBy(*keys)
        ends = ends.agg(F.max_by("_right", own(F.col("_tie"))).alias("_last"), F.min_by("_right", own(F.negative("_tie"))).alias("_first"))
        up = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        down = Window.partitionBy(by).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*keys, F.last("_last", True).over(up).alias("_last"), F.last("_first", True).over(down).alias("_first"))
        out = out.join(ends, keys, "left").withColumn("prev", F.coalesce("prev", "_last")).withColumn("next", F.coalesce("next", "_first"))
    meets = F.col(by).isNotNull() & F.col(on).isNotNull()
    return out.where("_side = 1").withColumns({"prev": F.when(meets, F.col("prev")), "next": F.when(meets, F.col("next"))}).drop("_right", "_side", "_tie", "_bucket", "_last", "_first")


def asof(left: DataFrame, right: DataFrame, by: str, on: str, values: list[str], before_first: str = "null", tie: str | None = None, shift: int = 0, bucket: int | None = None) -> DataFrame:
    """left with other_<on> and other_<value> of the last right row at or before `on` - shift.

    before_first: what holds before the first right row: null, clamp (to the first row) or zero.
    """
    at = left.withColumn("_own", F.col(on)).withColumn(on, F.col(on) - shift)
    got = around(at, right, by, on, values, tie, bucket).withColumn(on, F.col("_own")).drop("_own")
    picked = F.coalesce("prev", "next") if before_first == "clamp" else F.col("prev")
    fill = lambda c: F.coalesce(c, F.lit(0.0)) if before_first == "zero" else c
    return got.withColumns({f"other_{on}": picked[on], **{f"other_{v}": fill(picked[v]) for v in values}}).drop("prev", "next")


def asof_forward(left: DataFrame, right: DataFrame, by: str, on: str, values: list[str], tie: str | None = None, bucket: int | None = None) -> DataFrame:
    """left with the first right row at or after it."""
    got = around(left, right, by, on, values, tie, bucket)
    picked = F.when(F.col("prev")[on] == F.col(on), F.col("prev")).otherwise(F.col("next"))
    return got.withColumns({f"other_{x}": picked[x] for x in (on, *values)}).drop("prev", "next")


def nearest(left: DataFrame, right: DataFrame, by: str, on: str, values: list[str], tolerance: int, tie: str | None = None, bucket: int | None = None) -> DataFrame:
    """left with the nearest right row and ok: within the tolerance; equal distances go to the later row."""
    got = around(left, right, by, on, values, tie, bucket)
    before, after = F.col(on) - F.col("prev")[on], F.col("next")[on] - F.col(on)
    picked = F.when(F.col("prev").isNull() | (after <= before), F.coalesce("next", "prev")).otherwise(F.col("prev"))
    got = got.withColumns({f"other_{x}": picked[x] for x in (on, *values)}).drop("prev", "next")
    return got.withColumn("ok", F.coalesce(F.abs(F.col(f"other_{on}") - F.col(on)) <= tolerance, F.lit(False)))


def between(at: Column, on: str, value: str) -> Column:
    """Linear interpolation between prev and next; clamped at both ends."""
    t0, v0, t1, v1 = F.col("prev")[on], F.col("prev")[value], F.col("next")[on], F.col("next")[value]
    return F.when(F.col("prev").isNull(), v1).when(F.col("next").isNull() | (t0 == at), v0).otherwise(v0 + (v1 - v0) * ((at - t0) / (t1 - t0)))


def interpolate(left: DataFrame, right: DataFrame, by: str, on: str, value: str, tie: str | None = None, bucket: int | None = None) -> DataFrame:
    return around(left, right, by, on, [value], tie, bucket).withColumn(f"interp_{value}", between(F.col(on), on, value)).drop("prev", "next")


def fresh(left: DataFrame, right: DataFrame, by: str, on: str, most: int, bucket: int | None = None) -> DataFrame:
    """left with fresh: right has rows within `most` on both sides."""
    got = around(left, right, by, on, [], None, bucket)
    ok = (F.col(on) - F.col("prev")[on] <= most) & ((F.col("prev")[on] == F.col(on)) | (F.col("next")[on] - F.col(on) <= most))
    return got.withColumn("fresh", F.coalesce(ok, F.lit(False))).drop("prev", "next")


def mutual_pairs(a: DataFrame, b: DataFrame, by: str, on: str, key: str, tolerance: int, bucket: int | None = None) -> DataFrame:
    """One-to-one pairs (by, a_key, b_key): each is the other's nearest within the tolerance."""
    ab = nearest(a, b, by, on, [key], tolerance, None, bucket).where("ok").select(by, F.col(key).alias("a_key"), F.col(f"other_{key}").alias("b_key"))
    ba = nearest(b, a, by, on, [key], tolerance, None, bucket).where("ok").select(by, F.col(f"other_{key}").alias("a_key"), F.col(key).alias("b_key"))
    return ab.join(ba, [by, "a_key", "b_key"])


def band_pairs(a: DataFrame, b: DataFrame, by: str, on: str, width: int) -> DataFrame:
    """All pairs of one key within width in time; an equi-join on time buckets, each a row meets three of."""
    left = a.select(by, F.struct(*a.columns).alias("a"), F.floor(F.col(on) / width).alias("_bucket"))
    near = F.explode(F.array(*(F.floor(F.col(on) / width) + d for d in (-1, 0, 1)))).alias("_bucket")
    right = b.select(by, F.struct(*b.columns).alias("b"), near)
    return left.join(right, [by, "_bucket"]).where(F.abs(F.col("a")[on] - F.col("b")[on]) <= width).select("a", "b")


def first_response(inputs: DataFrame, outputs: DataFrame, by: str, on: str, bucket: int | None = None) -> DataFrame:
    """Each input with the time to the first output at or after it; null if unanswered."""
    got = asof_forward(inputs, outputs, by, on, [], None, bucket)
    return got.withColumn("latency", F.col(f"other_{on}") - F.col(on))


def freshest_of(outputs: DataFrame, inputs: DataFrame, by: str, on: str, arrival: str, last: int = 64, bucket: int | None = None) -> DataFrame:
    """Each output with the age, by arrival, of the freshest of the last inputs that had arrived by then: of those with a
    time no later than its own, the one with the latest time (of equal ones the last to arrive).  Null if there is none.

    Only inputs count among the last, however many outputs lie between; bucket is one of arrival.
    """
    known = inputs.where(F.col(by).isNotNull() & F.col(arrival).isNotNull()).select(by, arrival, F.col(on).alias("_on"))
    known = known.withColumn("_recent", F.collect_list(F.struct("_on", arrival)).over(Window.partitionBy(by).orderBy(arrival, "_on").rowsBetween(1 - last, 0)))
    got = asof(outputs, known, by, arrival, ["_recent"], tie="_on", bucket=bucket)
    freshest = F.array_max(F.filter(F.col("other__recent"), lambda x: x["_on"] <= F.col(on)))
    return got.withColumn("age", F.col(arrival) - freshest[arrival]).drop(f"other_{arrival}", "other__recent")


def answered(inputs: DataFrame, outputs: DataFrame, by: str, on: str, arrival: str, bucket: int | None = None, arrival_bucket: int | None = None) -> DataFrame:
    """Each input with answered_at: the later of the time of the first output that arrived at or after it and that
    of the first output with a time at or after its own; null where one of them is missing."""
    by_time = asof_forward(inputs, outputs, by, on, [], None, bucket).withColumnRenamed(f"other_{on}", "_a")
    by_arrival = asof_forward(by_time, outputs, by, arrival, [on], None, arrival_bucket).withColumnRenamed(f"other_{on}", "_b").drop(f"other_{arrival}")
    both = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.greatest("_a", "_b"))
    return by_arrival.withColumn("answered_at", both).drop("_a", "_b")


def history(left: DataFrame, right: DataFrame, by: str, on: str, value: str, delay: int, horizon: int, bucket: int | None = None) -> DataFrame:
    """left with past_<value>: right's value at `on` - delay, interpolated; the latest one where it ends before, and
    null where its last row by then is older than the horizon, or none is there."""
    at = left.withColumn("_own", F.col(on)).withColumn(on, F.col(on) - delay)
    got = around(at, right, by, on, [value], None, bucket)
    kept = F.col("prev").isNotNull() & (F.col(on) - F.col("prev")[on] <= horizon)
    got = got.withColumn(f"past_{value}", F.when(kept, F.when(F.col("next").isNull(), F.col("prev")[value]).otherwise(between(F.col(on), on, value))))
    return got.withColumn(on, F.col("_own")).drop("_own", "prev", "next")
