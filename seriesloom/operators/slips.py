"""Slips of all axles at once: entry, six ways out, timeouts, without a sequential pass over rows.

An automaton is idle or in a slip of one sign.  What makes it leave a slip
depends on the entry only by the entry's time, sign and size, and a slip ends
soon after `longest` at the latest.  So

1. every row gets marks that do not depend on the state: when each axle last
   jumped or came back, since when readings agree, the noise;
2. every row that could begin a slip gets its own way out, the first row of
   the following `longest` whose marks say so: a join on time buckets;
3. which of these entries really begin one is a chain over entries, which are
   few; it is cut where nothing before can reach, and each part is a fold of
   its own.

Marks need rows of the last `reach` only, so a run is split into buckets that
also get the end of the bucket before; no run is one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import timejoin
from .folds import Fold, fold, output


@dataclass(frozen=True)
class SlipRules:
    """Times in the unit of `us`; values in that of the readings."""

    axles: tuple[str, ...]
    live: int  # an axle counts so long after its last reading
    longest: int
    jump: float  # of a reading against what is expected
    least_share: float = 0.1  # of the expected value, that a jump at entry has
    least_value: float = 0.0  # expected, for an entry
    standstill: float = 0.0
    moving: float = 0.0  # zeros count above this
    returns: float = 0.0  # change of a reading toward what is expected, when an axle comes back gently
    settled: float = 0.0
    agree: int = 0  # time of readings accepted in succession
    noise_time: int = 0
    noise_weight: float = 3.0


def halo(df: DataFrame, by: list[str], on: str, width: int, reach: int) -> DataFrame:
    """df with _bucket and _own: each row in its own bucket of time, and again in the next ones that look back on it by reach."""
    own = F.floor(F.col(on) / width).cast("long")
    last = F.floor((F.col(on) + reach) / width).cast("long")
    return df.where(F.col(on).isNotNull()).withColumn("_bucket", F.explode(F.sequence(own, last))).withColumn("_own", F.col("_bucket") == own)


def least(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)


def every(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def marks(readings: DataFrame, r: SlipRules, width: int) -> DataFrame:
    """run, us, seq and what each reading (run, us, seq, axle, z, expected, ok) says whatever the state; see the module."""
    keys = ["run", "_bucket"]
    d = halo(readings.where(F.col("axle").isin(*r.axles)), ["run"], "us", width, r.longest + max(r.live, r.noise_time, r.agree) * 2)
    own = Window.partitionBy(*keys, "axle").orderBy("us", "seq")
    to_now = Window.partitionBy(*keys).orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag(F.struct("us", "z", "expected")).over(own)
    change = F.col("z") - before["z"] - (F.col("expected") - before["expected"])
    d = d.withColumn("dz", F.when(F.col("us") - before["us"] <= r.live, change))
    d = d.withColumn("side", F.when(F.col("dz") >= r.jump, 1).when(F.col("dz") <= -r.jump, -1))
    accepted_before = F.coalesce(F.lag("ok").over(Window.partitionBy(*keys).orderBy("us", "seq")), F.lit(False))
    quiet = F.when(F.col("side").isNull(), F.abs("dz"))
    seen, highs = {}, {}
    for a in r.axles:
        here = F.col("axle") == a
        seen |= {
            f"seen_{a}": F.last(F.when(here, F.struct("us", "z", "expected")), True).over(to_now),
            f"jump_{a}": F.last(F.when(here & F.col("side").isNotNull(), F.struct("us", "side", F.abs("dz").alias("size"))), True).over(to_now),
        }
        for name, s in (("up", 1), ("down", -1)):
            seen[f"back_{name}_{a}"] = F.max(F.when(here & (F.col("side") == -s), F.col("us"))).over(to_now)
            seen[f"high_{name}_{a}"] = F.max(F.when(here & (-s * F.col("dz") > r.returns), F.col("us"))).over(to_now)
            highs[f"home_{name}_{a}"] = F.max(F.when(here & (-s * F.col("dz") < r.settled), F.col(f"high_{name}_{a}"))).over(to_now)
    d = d.withColumns(seen | {
        "noise": F.avg(quiet).over(Window.partitionBy(*keys).orderBy("us").rangeBetween(-r.noise_time, 0)),
        "since": F.when(F.col("ok"), F.max(F.when(F.col("ok") & ~accepted_before, F.col("us"))).over(to_now)),
    }).withColumn("accepted_before", accepted_before).withColumns(highs)
    live = {a: F.coalesce(F.col("us") - F.col(f"seen_{a}")["us"] <= r.live, F.lit(False)) for a in r.axles}
    n_live = reduce(lambda x, y: x + y, (v.cast("int") for v in live.values()))
    expected = reduce(lambda x, y: x + y, (F.when(v, F.col(f"seen_{a}")["expected"]).otherwise(0.0) for a, v in live.items())) / n_live
    still = every([~v | F.coalesce(F.col(f"seen_{a}")["z"] < r.standstill, F.lit(False)) for a, v in live.items()])
    # of the axles that are live: the one that came back earliest; none: never
    home = lambda name: least([F.when(v, F.coalesce(F.greatest(f"back_{name}_{a}", f"home_{name}_{a}"), F.lit(-(1 << 62)))).otherwise(F.lit(1 << 62)) for a, v in live.items()])
    first = [F.col(f"jump_{a}") for a in r.axles]
    sign = F.coalesce(*(F.when(live[a], F.col(f"jump_{a}")["side"]) for a in r.axles))
    recent = every([~live[a] | F.coalesce(F.col("us") - j["us"] <= r.live, F.lit(False)) for a, j in zip(r.axles, first, strict=True)])
    size = least([F.when(live[a], j["size"]).otherwise(F.lit(float("inf"))) for a, j in zip(r.axles, first, strict=True)])
    oldest = least([F.when(live[a], j["us"]).otherwise(F.lit(1 << 62)) for a, j in zip(r.axles, first, strict=True)])
    same = every([~live[a] | F.coalesce((j["side"] == sign) & (sign * (F.col(f"seen_{a}")["z"] - F.col(f"seen_{a}")["expected"]) > 0), F.lit(False)) for a, j in zip(r.axles, first, strict=True)])
    d = d.where("_own").withColumns({"live": n_live, "v": F.when(n_live > 0, expected), "sign": sign, "recent": recent, "size": size, "oldest": oldest, "same": same, "still": still & (n_live > 0), "home_up": home("up"), "home_down": home("down")})
    entry = (F.col("live") >= 2) & F.col("recent") & F.col("same") & (F.col("size") >= r.least_share * F.col("v")) & (F.col("v") > r.least_value) & ~F.col("still")
    return d.select("run", "us", "seq", F.coalesce(entry, F.lit(False)).alias("entry"), "sign", "size", "oldest", F.coalesce(F.col("still") & (F.col("v") > r.moving), F.lit(False)).alias("zeros"), "noise", "since", F.when(F.col("live") > 0, F.col("home_up")).alias("home_up"), F.when(F.col("live") > 0, F.col("home_down")).alias("home_down"))


def ways_out(marked: DataFrame, r: SlipRules) -> DataFrame:
    """run, us, seq, sign, oldest of every possible entry with end and how (null: none in the run): the first later row that ends it."""
    e = marked.where("entry").select("run", F.col("us").alias("begin"), F.col("seq").alias("first"), "sign", "size", "oldest")
    near = e.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("begin") / r.longest), F.floor(F.col("begin") / r.longest) + 1)))
    rows = marked.withColumn("_bucket", F.floor(F.col("us") / r.longest))
    met = near.join(rows.select("run", "_bucket", "us", "seq", "zeros", "noise", "since", "home_up", "home_down"), ["run", "_bucket"])
    met = met.where((F.struct("us", "seq") > F.struct(F.col("begin").alias("us"), F.col("first").alias("seq"))) & (F.col("us") - F.col("begin") <= r.longest))
    home = F.when(F.col("sign") > 0, F.col("home_up")).otherwise(F.col("home_down"))
    how = (
        F.when(F.col("zeros"), "zeros").when(r.jump + r.noise_weight * F.col("noise") >= F.col("size"), "noise").when((home > F.col("begin")) & (home < (1 << 62)), "back")
        .when(F.col("since").isNotNull() & (F.col("us") - F.greatest("since", "begin") >= r.agree), "agree")
    )
    ended = met.withColumn("how", how).where("how is not null").groupBy("run", "first").agg(F.min(F.struct("us", "seq", "how")).alias("out"))
    # a timeout is the first row beyond `longest`
    limit = e.select("run", "first", (F.col("begin") + r.longest).alias("us"))
    late = timejoin.around(limit, marked.select("run", "us", "seq"), "run", "us", ["seq"], "seq", r.longest)
    timed = late.where("next is not null").select("run", "first", F.struct(F.col("next.us").alias("us"), F.col("next.seq").alias("seq"), F.lit("timeout").alias("how")).alias("late"))
    out = e.join(ended, ["run", "first"], "left").join(timed, ["run", "first"], "left").withColumn("out", F.coalesce("out", "late"))
    return out.select("run", F.col("begin").alias("us"), F.col("first").alias("seq"), "sign", "size", "oldest", F.col("out.us").alias("end"), F.col("out.seq").alias("last"), F.col("out.how").alias("how"))


@dataclass
class Chain:
    end: int | None = None  # of the slip before
    last: int | None = None
    open: bool = False
    timeout_sign: int = 0
    timeout_at: int | None = None


def chain(longest: int) -> Fold:
    """Which entries begin a slip: behind the one before, by jumps of their own, and no mere return after a timeout."""

    def step(s: Chain, e: dict) -> list[tuple]:
        if s.open or (s.end is not None and ((e["us"], e["seq"]) <= (s.end, s.last) or e["oldest"] <= s.end)):
            return []
        if s.timeout_at is not None and s.timeout_sign == -e["sign"] and e["us"] - s.timeout_at <= longest:
            return []
        s.end, s.last, s.open = e["end"], e["last"], e["end"] is None
        if e["how"] == "timeout":
            s.timeout_sign, s.timeout_at = e["sign"], e["end"]
        return [(e["us"], e["sign"], e["size"], e["end"], e["how"])]

    return Fold(Chain, step, ["us", "seq", "sign", "size", "oldest", "end", "last", "how"], "us long, sign int, size double, end long, how string")


def slips(readings: DataFrame, r: SlipRules, width: int) -> DataFrame:
    """run, us, sign, size, end, how: the slips of readings (run, us, seq, axle, z, expected, ok).

    A slip begins where every live axle, two at least, has jumped to one side
    and reads on that side of what is expected.  It ends where all read zero on
    the move, the noise explains the jump, every live axle has jumped back or
    come back gently, readings were accepted long enough, or it has lasted too
    long (timeout); end is null where the run ends first.
    """
    found = ways_out(marks(readings, r, width), r)
    # a part begins where all that came before, and what it remembers, has ended
    w = Window.partitionBy("run").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.coalesce(F.col("end") + r.longest, F.lit(1 << 62))).over(w)
    cut = found.withColumn("_new", F.coalesce((F.col("oldest") > reach).cast("int"), F.lit(1)))
    parts = cut.withColumn("part", F.sum("_new").over(Window.partitionBy("run").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)))
    return output(fold(parts, ["run", "part"], ["us", "seq"], chain(r.longest))).select("run", "us", "sign", "size", "end", "how")
