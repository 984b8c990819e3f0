"""Corrections of a travelled way by position fixes that come late.

A run has a way that wheels give, continuous but drifting, and fixes that tell
where it was: along the way, and how far off it to the side.  Pairing of fixes,
the way at a fix's own time and the weights are joins and expressions; what
remains is a fold over fixes, a few numbers each, whose state is an offset and
its variance.  Corrected places follow by an as-of join of the offsets.

Rules.  A small correction that agrees with the estimate is made at once, if
the last one is long enough ago.  A larger one needs several fixes in succession
that agree with one another; one that the estimate rules out (beyond the gate,
or to the side) needs precise fixes that persist, the longer if the fixes, and
not the way, have jumped.  Then the estimate counts as lost: the offset is taken
from the fix, and a place far away or to the side is moved to as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import hypot, inf, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import timejoin
from .folds import Fold
from .lineage import cut

OUT = "us long, verdict string, misfit double, offset double, sigma double"


@dataclass(frozen=True)
class Rules:
    """Times in the unit of `us`, lengths in that of the way."""

    gate: float = 3.0
    jump: float = 2.0  # the largest correction made without confirmation
    drift: float = 0.01  # growth of sigma per length of way
    least_side: float = 4.0
    interval: tuple[int, int] = (0, 0)  # between corrections: imprecise, precise
    precise: int = 2  # least status of a precise fix
    confirm: int = 3  # fixes in succession
    confirm_time: int = 0
    persist: int = 0
    persist_jumped: int = 0
    delay: int = 0
    jump_time: int = 0
    jump_size: float = 8.0
    pending: int = 64
    drift_spread: float = 0.02
    far_along: float = 15.0
    far_most: float = 500.0


@dataclass
class Track:
    """offset on the way, its variance, where on the way and when it was set; the last fix that agreed; those that wait."""

    offset: float = 0.0
    variance: float = 100.0
    way: float | None = None
    stamp: float = -inf
    agreed: list | None = None
    waiting: list = field(default_factory=list)
    jumped: bool = False


def judge(s: Track, e: dict, r: Rules) -> tuple[str, float, float, float]:
    """What becomes of one fix: verdict, share of the misfit to add to the offset, the misfit and the variance after."""
    us, sd, side = e["us"], e["sd"], e["side"]
    misfit = e["along"] - s.offset - e["way"]
    grown = s.variance + (r.drift * (0.0 if s.way is None else abs(e["way"] - s.way))) ** 2
    gain = grown / (grown + sd * sd)
    possible = abs(misfit) <= r.gate * sqrt(grown + sd * sd)
    beside = abs(side) > max(r.least_side, 3 * sd)
    precise = e["status"] >= r.precise
    if possible and not beside and abs(gain * misfit) <= r.jump:
        s.waiting, s.agreed = [], [us, misfit]
        if us - s.stamp < r.interval[precise]:
            return "skipped", 0.0, misfit, s.variance
        return "small", gain, misfit, (1 - gain) * grown
    if not s.waiting:
        s.jumped = s.agreed is not None and us - s.agreed[0] <= r.jump_time and abs(misfit - s.agreed[1]) > r.jump_size + 3 * sd
    hold = max(r.persist, r.persist_jumped) if s.jumped else r.persist
    span = max(r.confirm_time, hold)
    s.waiting = ([w for w in s.waiting if us - w[0] <= span] + [[us, misfit, side, sd, possible and not beside, precise, e["way"]]])[-r.pending :]
    if not precise:
        return "imprecise", 0.0, misfit, s.variance
    chosen = s.waiting[-r.confirm :]
    if len(chosen) < r.confirm or us - chosen[0][0] > r.confirm_time:
        return "waits", 0.0, misfit, s.variance
    spread = 1 + 2 * max(w[3] for w in chosen)
    lost = s.jumped or not all(w[4] and w[5] for w in chosen)
    if lost:
        chosen = [w for w in s.waiting if us - w[0] <= hold]
        if not all(w[5] for w in chosen) or us - chosen[0][0] < hold - r.delay:
            return "waits", 0.0, misfit, s.variance
    reach = lambda k: max(w[k] for w in chosen) - min(w[k] for w in chosen)
    if reach(1) > spread + r.drift_spread * reach(6) or reach(2) > spread:
        return "waits", 0.0, misfit, s.variance
    s.waiting = []
    if lost:
        grown = max(grown, misfit**2 + side**2)
        gain = grown / (grown + sd * sd)
    if beside or abs(misfit) > r.far_along:
        if hypot(misfit, side) <= r.far_most:
            return "moved", 1.0, misfit, (1 - gain) * grown
        if beside or abs(misfit) > 10 * r.far_along:
            return "refused", 0.0, misfit, s.variance
    return "large", gain, misfit, (1 - gain) * grown


def correction(r: Rules) -> Fold:
    """The fold over fixes (us, along, side, sd, status, way); those without a way or place count for nothing."""

    def step(s: Track, e: dict) -> list[tuple]:
        if any(e[c] is None for c in ("us", "along", "side", "sd", "status", "way")):
            return []
        verdict, share, misfit, variance = judge(s, e, r)
        if share:
            s.offset, s.variance, s.way, s.stamp = s.offset + share * misfit, variance, e["way"], e["us"]
        return [(e["us"], verdict, misfit, s.offset, sqrt(s.variance))]

    return Fold(Track, step, ["us", "along", "side", "sd", "status", "way"], OUT)


def epochs(fixes: DataFrame, other: DataFrame, tolerance: int, single_sd: float, bucket: int | None = None) -> DataFrame:
    """run, seq, us, along, side, sd, status of fixes (run, seq, us, along, side, sd, status) of two receivers.

    Fixes that are one another's nearest within the tolerance are one: the mean
    place, the larger sd, the lower status, the first one's time.  A lone one
    is less certain by single_sd.
    """
    pairs = cut(timejoin.mutual_pairs(fixes, other, "run", "us", "seq", tolerance, bucket))
    b = other.select("run", F.col("seq").alias("b_key"), *(F.col(c).alias(f"_{c}") for c in ("along", "side", "sd", "status")))
    one = fixes.join(pairs.withColumnRenamed("a_key", "seq"), ["run", "seq"], "left").join(b, ["run", "b_key"], "left")
    both = F.col("b_key").isNotNull()
    lone = F.sqrt(F.col("sd") ** 2 + single_sd**2)
    one = one.select(
        "run", "seq", "us", *(F.when(both, (F.col(c) + F.col(f"_{c}")) / 2).otherwise(F.col(c)).alias(c) for c in ("along", "side")),
        F.when(both, F.greatest("sd", "_sd")).otherwise(lone).alias("sd"), F.when(both, F.least("status", "_status")).otherwise(F.col("status")).alias("status"),
    )
    rest = other.join(pairs.select("run", F.col("b_key").alias("seq")), ["run", "seq"], "left_anti")
    return one.unionByName(rest.select("run", "seq", "us", "along", "side", lone.alias("sd"), "status"))


def with_way(fixes: DataFrame, way: DataFrame, bucket: int | None = None) -> DataFrame:
    """fixes with way: the way (run, us, way) at their own time, or null before its first row."""
    got = timejoin.around(fixes, way, "run", "us", ["way"], bucket=bucket)
    return got.withColumn("way", F.when(F.col("prev").isNotNull(), timejoin.between(F.col("us"), "us", "way"))).drop("prev", "next")


def corrected(way: DataFrame, verdicts: DataFrame, delay: int, bucket: int | None = None) -> DataFrame:
    """way (run, us, way) with place and sigma: the way with the last offset of a fix that is `delay` old; the way itself before."""
    got = timejoin.asof(way, verdicts, "run", "us", ["offset", "sigma"], shift=delay, tie="seq" if "seq" in verdicts.columns else None, bucket=bucket)
    return got.select("run", "us", "way", (F.col("way") + F.coalesce("other_offset", F.lit(0.0))).alias("place"), F.col("other_sigma").alias("sigma"))
