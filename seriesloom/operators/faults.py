"""Seeded faults on a window of a series, slip shapes, and availability windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts; the same on every engine and run."""
    text = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def normal(*parts: Column) -> Column:
    """A standard normal number from two hashes."""
    u, v = uniform(*parts, F.lit("u")), uniform(*parts, F.lit("v"))
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)


KINDS = ["zero", "drop", "stuck", "scale_low", "scale_high", "scale_triple", "noise", "missing", "stamp_jump", "zero_then_drop", "outliers", "spike"]


def with_fault(df: DataFrame, kind: str, start: Column, length: int, before: int = 1_000_000, jump: int = 30_000_000, sigma: float = 5.0, apart: int = 5_000_000) -> DataFrame:
    """Rows (run, seq, us, value) of df with one kind of fault on [start, start + length) of each run; start uses the run's columns."""
    by_time = Window.partitionBy("run").orderBy("us", "seq")
    df = df.withColumn("_t0", start).withColumn("_in", (F.col("us") >= F.col("_t0")) & (F.col("us") < F.col("_t0") + length))
    nth = F.sum(F.col("_in").cast("int")).over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    v, inside, drop = F.col("value"), F.col("_in"), None
    if kind == "zero":
        v = F.when(inside, 0.0).otherwise(v)
    elif kind == "drop":
        drop = inside
    elif kind == "stuck":
        held = F.last(F.when(~inside & (F.col("us") < F.col("_t0")), F.col("value")), True).over(by_time.rowsBetween(Window.unboundedPreceding, 0))
        v = F.when(inside, F.coalesce(held, F.lit(0.0))).otherwise(v)
    elif kind.startswith("scale"):
        v = F.when(inside, v * {"scale_low": 0.7, "scale_high": 1.3, "scale_triple": 3.0}[kind]).otherwise(v)
    elif kind == "noise":
        v = F.when(inside, v + sigma * normal(F.col("run"), F.col("seq"), F.lit(kind))).otherwise(v)
    elif kind == "missing":
        v = F.when(inside & (nth == 1), F.lit(None).cast("double")).otherwise(v)
    elif kind == "stamp_jump":
        df = df.withColumn("us", F.when(inside & (nth == 1), F.col("us") + jump).otherwise(F.col("us")))
    elif kind == "zero_then_drop":
        v = F.when((F.col("us") >= F.col("_t0") - before) & (F.col("us") < F.col("_t0")), 0.0).otherwise(v)
        drop = inside
    elif kind == "outliers":
        # the first row from the start on, the first two behind one pause, the first three behind two
        hit = F.lit(False)
        for k in range(3):
            late = F.col("us") >= F.col("_t0") + k * apart
            hit = hit | (late & (F.sum(late.cast("int")).over(by_time.rowsBetween(Window.unboundedPreceding, 0)) <= k + 1))
        v = F.when(hit, v * 3).otherwise(v)
    elif kind == "spike":
        v = F.when(inside & (nth == 1), v + 1000).otherwise(v)
    else:
        raise ValueError(f"unknown fault kind {kind!r}")
    df = df.withColumn("value", v)
    return (df.where(~drop) if drop is not None else df).select("run", "seq", "us", "value")


def slip_shape(kind: str, x: Column, length: float, low: float) -> Column:
    """The multiplier at x seconds into a slip of that length; 1 outside."""
    fall, rise = F.least(x / (0.25 * length), F.lit(1.0)), F.least((length - x) / (0.25 * length), F.lit(1.0))
    inside = {
        "step": F.lit(low),
        "ramp_in": 1 - (1 - low) * fall,
        "ramp_out": 1 - (1 - low) * rise,
        "ramp_both": 1 - (1 - low) * F.least(fall, rise),
        "lock": F.lit(0.0),
        "then_lock": F.when(x < 0.5 * length, F.lit(low)).otherwise(0.0),
        "lock_ramp": F.greatest(1 - x / (0.5 * length), F.lit(0.0)),
        "pulsed": F.when(F.floor(x / (0.125 * length)) % 2 == 0, F.lit(low)).otherwise(1.0),
    }[kind]
    return F.when((x >= 0) & (x < length), inside).otherwise(1.0)


SHAPES = ["step", "ramp_in", "ramp_out", "ramp_both", "lock", "then_lock", "lock_ramp", "pulsed"]
SCENARIOS = ["full", "none", "first", "nostart", "midstart", "sparse", "bursts"]


def available(kind: str, us: Column, start: Column, end: Column, run: Column, unit: int) -> Column:
    """Is a row of a run available; windows of one unit are drawn by hash."""
    k = F.floor((us - start) / unit)
    return {
        "full": F.lit(True),
        "none": F.lit(False),
        "first": us < start + 3 * unit,
        "nostart": us >= start + 3 * unit,
        "midstart": us >= start + (end - start) * (0.5 * uniform(run, F.lit("midstart"))),
        "sparse": uniform(run, k, F.lit("sparse")) < 0.25,
        "bursts": (k % 4 == 0) & (uniform(run, k, F.lit("bursts")) < 0.75),
    }[kind]


#: Chances of the glitches of a burst.
GLITCHES = {"jump": 0.5, "stamp": 0.3, "degraded": 0.25, "alone": 0.25, "garbage": 0.3}


def glitchy(df: DataFrame, start: Column, unit: int, second: str, second_long: int) -> DataFrame:
    """Rows (run, seq, receiver, tb, th, x, y, status) of three units from a run's start on, and of bursts of one unit after them with glitches.

    start uses the row's columns.  Bursts are units as in `sparse`; which glitches one has, and how large, is drawn by
    hash: a jump of 15 to 80 on one to five epochs (equal th), stamps moved by a second (`second_long`) for 2 to 4 tenths
    of the unit, status 0 and a shift of 5 to 15, no rows of the receiver `second`, and three rows of garbage before the
    burst's first row (0, 0; no x; status -1), whose seq is null.
    """
    d = df.withColumn("_k", F.floor((F.col("tb") - start) / unit))
    draw = lambda name: uniform(F.col("run"), F.col("_k"), F.lit(name))
    has = lambda name: F.col("_burst") & (draw(name) < GLITCHES[name])
    d = d.where((F.col("_k") < 3) | (draw("sparse") < 0.25)).withColumn("_burst", F.col("_k") >= 3)
    burst = Window.partitionBy("run", "_k")
    d = d.withColumns({"_e": F.dense_rank().over(burst.orderBy("th")) - 1, "_lo": F.min("tb").over(burst)}).withColumn("_all", F.max("_e").over(burst) + 1)
    n = 1 + F.floor(5 * draw("jump_n"))
    at = F.floor(draw("jump_at") * F.greatest(F.lit(1), F.col("_all") - n))
    since = (0.8 * draw("stamp_at")) * unit
    length = (0.2 + 0.2 * draw("stamp_length")) * unit
    into = F.col("tb") - F.col("_lo")
    jumps = has("jump") & (F.col("_e") >= at) & (F.col("_e") < at + n)
    far = F.when(jumps, 15 + 65 * draw("jump_far")).otherwise(0.0), 2 * F.pi() * draw("jump_turn")
    off = F.when(has("degraded"), 5 + 10 * draw("off_far")).otherwise(0.0), 2 * F.pi() * draw("off_turn")
    moved = has("stamp") & (into >= since) & (into <= since + length)
    sign = F.when(draw("stamp_sign") < 0.5, -1).otherwise(1)
    kept = d.where(~(has("alone") & (F.col("receiver") == second)))
    out = kept.select(
        "run", "seq", "receiver", "tb", F.when(moved, F.col("th") + sign * second_long).otherwise(F.col("th")).alias("th"),
        (F.col("x") + far[0] * F.sin(far[1]) + off[0] * F.sin(off[1])).alias("x"), (F.col("y") + far[0] * F.cos(far[1]) + off[0] * F.cos(off[1])).alias("y"),
        F.when(has("degraded"), 0).otherwise(F.col("status")).alias("status"),
    )
    # the first row of a burst with garbage brings three more
    order = Window.partitionBy("run", "_k").orderBy("tb", "seq")
    first = d.where(has("garbage")).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    rows = [(1, F.col("receiver"), 0, F.lit(0.0), F.lit(0.0), 0), (2, F.lit(second), 0, F.lit(None).cast("double"), F.col("y"), 2), (3, F.col("receiver"), 5, F.col("x"), F.col("y"), -1)]
    more = [F.struct(who.alias("receiver"), (F.col("tb") + k).alias("tb"), (F.col("th") + late).alias("th"), x.alias("x"), y.alias("y"), F.lit(status).alias("status")) for k, who, late, x, y, status in rows]
    garbage = first.select("run", F.lit(None).cast("long").alias("seq"), F.explode(F.array(*more)).alias("g")).select("run", "seq", "g.*")
    return out.unionByName(garbage)
