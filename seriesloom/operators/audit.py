"""The audit of recordings: one row a run with all figures of its topics, its stamps and its order.

Rows are run, topic, seq, tb (arrival), th (stamp), value; both times in microseconds, a stamp of 0 is none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_before(df: DataFrame, keys: list[str], order: list[str], values: list[str], peak: str, bucket: int) -> DataFrame:
    """df with before (struct of values of the key's row before) and peak (the greatest so far), by order, whose first column is a time.

    Windows run within time buckets; what a bucket inherits comes from a table of one row per key and bucket.
    """
    d = df.withColumn("_b", F.floor(F.col(order[0]) / bucket))
    own = Window.partitionBy(*keys, "_b").orderBy(*order)
    per = d.groupBy(*keys, "_b").agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v"), F.max(peak).alias("_m"))
    over = Window.partitionBy(*keys).orderBy("_b")
    per = per.select(*keys, "_b", F.lag("_v").over(over).alias("_v"), F.max("_m").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_m"))
    d = d.withColumns({"before": F.lag(F.struct(*values)).over(own), "peak": F.max(peak).over(own.rowsBetween(Window.unboundedPreceding, 0))}).join(per, [*keys, "_b"])
    return d.withColumns({"before": F.coalesce("before", "_v"), "peak": F.greatest("peak", "_m")}).drop("_b", "_v", "_m")


@dataclass(frozen=True)
class AuditRules:
    late: int = 500_000  # a stamp off by more than this, a leap, a gap
    gap: int = 1_000_000  # a long gap
    slight: int = 50_000  # later than this behind the greatest stamp so far counts as late
    start: int = 2_000_000  # of a recording: buffers empty themselves
    epoch: int = 100_000  # stamps on whole multiples
    moving: float = 0.5
    looks: tuple[int, ...] = (3_000_000, 10_000_000)  # does it move within these?


FIGURES = "n first_s tail_s rate max_gap_s gaps long_gaps dropped_s arrival_dup stamp_gap_s back back_max_s dup zero off_med_s off_min_s off_max_s off_std_s off_big off_last_s epochs start_backlog start_backlog_s ahead behind glitch_first_s glitch_last_s glitch_most_s nulls neg least most begins changes rest_share".split()


def topic_figures(df: DataFrame, r: AuditRules, bucket: int) -> DataFrame:
    """run, topic and FIGURES: times in seconds since the run's first row, gaps by arrival, offsets of arrival less stamp
    against their median in the topic.  Rows without run, topic or arrival take no part; figures of nothing are null."""
    d = df.where("run is not null and topic is not null and tb is not null")
    ends = d.groupBy("run").agg(F.min("tb").alias("t0"), F.max("tb").alias("t1"))
    off = F.when(F.col("th") != 0, F.col("tb") - F.col("th"))
    middle = d.groupBy("run", "topic").agg(F.percentile(off, F.lit(0.5)).alias("_med"))
    d = with_before(d, ["run", "topic"], ["tb", "seq"], ["tb", "th", "value"], "th", bucket).join(ends, "run").join(middle, ["run", "topic"])
    dtb, dth = F.col("tb") - F.col("before.tb"), F.col("th") - F.col("before.th")
    at, g = F.col("tb") - F.col("t0"), off - F.col("_med")
    early = at <= r.start
    sec = lambda c: c / 1e6
    glitch = ~early & (F.abs(g) > r.late)
    v = F.when(~F.isnan("value"), F.col("value"))
    n = F.count("*")
    a: dict[str, Column] = {
        "n": n, "first_s": sec(F.min(at)), "tail_s": sec(F.min(F.col("t1")) - F.max("tb")), "rate": (n - 1) / F.nullif(sec(F.max("tb") - F.min("tb")), F.lit(0.0)),
        "max_gap_s": sec(F.max(dtb)), "gaps": F.count_if(dtb > r.late), "long_gaps": F.count_if(dtb > r.gap), "dropped_s": sec(F.sum(F.when(dtb > r.late, dtb))), "arrival_dup": F.count_if(dtb == 0),
        "stamp_gap_s": sec(F.max(dth)), "back": F.count_if(dth < 0), "back_max_s": sec(F.max(F.when(dth < 0, -dth))), "dup": F.count_if(dth == 0), "zero": F.count_if(F.col("th") == 0),
        "off_med_s": sec(F.max("_med")), "off_min_s": sec(F.min(off)), "off_max_s": sec(F.max(off)), "off_std_s": sec(F.stddev_pop(off)), "off_big": F.count_if(off > r.late),
        "off_last_s": sec(F.max(F.when(off > r.late, at))), "epochs": F.count_if((F.col("th") != 0) & (F.col("th") % r.epoch == 0)) / F.nullif(F.count(off), F.lit(0)),
        "start_backlog": F.count_if(early & (g > r.late)), "start_backlog_s": sec(F.max(F.when(early, g))), "ahead": F.count_if(~early & (g < -r.late)), "behind": F.count_if(~early & (g > r.late)),
        "glitch_first_s": sec(F.min(F.when(glitch, at))), "glitch_last_s": sec(F.max(F.when(glitch, at))), "glitch_most_s": sec(F.max(F.when(glitch, F.abs(g)))),
        "nulls": n - F.count(v), "neg": F.count_if(v < 0), "least": F.min(v), "most": F.max(v), "begins": F.min_by("value", F.struct("tb", "seq")),
        "changes": F.count_if(F.col("value") != F.col("before.value")), "rest_share": F.count_if(v == 0) / F.nullif(F.count(v), F.lit(0)),
    }
    return d.groupBy("run", "topic").agg(*(a[f].alias(f) for f in FIGURES))


def order_figures(df: DataFrame, inputs: list[str], r: AuditRules, bucket: int) -> DataFrame:
    """run and what a reader in order of arrival sees of its inputs: late rows and leaps of the clock at the start and after
    it, and how fast the run begins (greatest value within each look, null if there is none)."""
    d = df.where("run is not null and tb is not null and th is not null").join(df.groupBy("run").agg(F.min("tb").alias("t0")), "run").where(F.col("topic").isin(inputs))
    d = d.withColumn("top", F.col("th"))
    # the clock before a row is the greatest stamp of all rows before it
    d = with_before(d, ["run"], ["tb", "seq"], ["tb"], "top", bucket)
    d = with_before(d.withColumn("clock", F.col("peak")).drop("before", "peak"), ["run"], ["tb", "seq"], ["clock"], "clock", bucket)
    at, late, leap = F.col("tb") - F.col("t0"), F.col("clock") - F.col("th"), F.col("clock") - F.col("before.clock")
    early = at <= r.start
    sec = lambda c: c / 1e6
    fast = [F.max(F.when(at <= look, F.when(~F.isnan("value"), F.col("value")))) for look in r.looks]
    names = [f"in_{look // 1_000_000}_s" for look in r.looks]
    return d.groupBy("run").agg(
        F.count_if(early & (late > r.slight)).alias("late_start"), sec(F.max(F.when(early, late))).alias("late_start_s"), F.count_if(~early & (late > r.slight)).alias("late_mid"), sec(F.max(F.when(~early, late))).alias("late_mid_s"),
        F.count_if(~early & (leap > r.late)).alias("leaps"), sec(F.max(F.when(~early, leap))).alias("leap_s"),
        *(f.alias(f"most_{n}") for f, n in zip(fast, names, strict=True)), *((f > r.moving).alias(f"moving_{n}") for f, n in zip(fast, names, strict=True)),
    )


def run_audit(df: DataFrame, topics: list[str], inputs: list[str], r: AuditRules = AuditRules(), bucket: int = 3_600_000_000) -> DataFrame:
    """One row a run: start, seconds, rows, topics, whether it has just the expected topics, sums over topics, order_figures,
    and each of FIGURES for each expected topic as <figure>_<topic>.

    Counts of a missing topic are null.  The figures of a run and topic are one small row before they are laid side by side.
    """
    per = topic_figures(df, r, bucket)
    known = df.where("run is not null and topic is not null and tb is not null")
    whole = known.groupBy("run").agg(F.min("tb").alias("start"), ((F.max("tb") - F.min("tb")) / 1e6).alias("seconds"))
    side = [F.max(F.when(F.col("topic") == t, F.col(f))).alias(f"{f}_{t}") for t in topics for f in FIGURES]
    expected = F.col("topic").isin(topics)
    g = per.groupBy("run").agg(
        F.sum("n").alias("rows"), F.count("*").alias("topics"), ((F.count("*") == len(topics)) & F.bool_and(expected)).alias("complete"),
        *(F.sum(f).alias(f"all_{f}") for f in ("zero", "back", "off_big", "start_backlog")), F.max("off_last_s").alias("backlog_last_s"), F.max("off_max_s").alias("worst_off_s"),
        F.max(F.col("glitch_last_s") - F.col("glitch_first_s")).alias("glitch_span_s"), *side,
    )
    return whole.join(g, "run").join(order_figures(known, inputs, r, bucket), "run", "left")
