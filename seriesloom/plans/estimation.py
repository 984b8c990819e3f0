"""Queries of stateful estimation: late corrections, branches from snapshots, slips of all axles."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import corrections, folds, slips, stats, tables, timejoin
from ..operators.lineage import cut, shared_folder
from ..sources.tables import series, table
from ..streaming import alignment, runner
from .events import HOUR, S

QUERIES, SQL = {}, {}
DAY, SPAN = 24 * HOUR, 240 * HOUR


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


RULES = corrections.Rules(
    gate=3, jump=8, drift=0.08, least_side=5, interval=(3 * DAY, DAY), confirm=2, confirm_time=12 * DAY, persist=6 * DAY, persist_jumped=9 * DAY, delay=DAY, jump_time=6 * DAY, jump_size=20, drift_spread=0.5, far_along=60, far_most=5000
)


def way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, us, way: the summed values of views."""
    w = Window.partitionBy("run").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return series(spark, sf_dir, "view").where("value is not null").withColumn("way", F.sum(F.round("value", 2).cast("decimal(18,2)")).over(w).cast("double")).groupBy("run", "us").agg(F.max("way").alias("way"))


def fixes(spark: SparkSession, sf_dir: str, topic: str, at: DataFrame) -> DataFrame:
    """Fixes from a topic's events: the way then, drifted by five hundredths, off by their value less fifty or, now and then and in some runs, far off."""
    d = series(spark, sf_dir, topic).where("value is not null")
    d = corrections.with_way(d, at, SPAN).where("way is not null")
    off = F.when(F.col("run") % 5 == 1, 90.0).when(F.col("seq") % 17 < 2, 40.0).otherwise((F.col("value") - 50) / 10)
    return d.select("run", "seq", "us", (F.col("way") * 1.05 + off).alias("along"), ((F.col("seq") % 23) / 4.0).alias("side"), (1.0 + F.col("seq") % 3).alias("sd"), F.when(F.col("seq") % 5 == 0, 1).otherwise(2).alias("status"))


def located(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The way, and fixes of two receivers paired and laid on it."""
    # pairing reads each of these several times
    at = cut(way(spark, sf_dir))
    a, b = (cut(fixes(spark, sf_dir, topic, at)) for topic in ("purchase", "signup"))
    e = corrections.epochs(a, b, 6 * HOUR, 1.5, SPAN)
    return at, corrections.with_way(e, at, SPAN)


@query()
def late_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all fixes, every seventh of which comes late: they are folded in from the stretch they fall into."""
    _, e = located(spark, sf_dir)
    e = cut(e)
    line = folds.Timeline(spark, f"{shared_folder(spark)}/late-{uuid4().hex}", ["run"], ["us", "seq"], "us", SPAN, corrections.correction(RULES))
    line.commit(e.where("seq % 7 <> 3"), 1)
    line.commit(e.where("seq % 7 = 3"), 2)
    return line.output()


@query()
def corrected_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way at every view with the offset of the last fix that is a day old."""
    at, e = located(spark, sf_dir)
    verdicts = folds.output(folds.fold(e, ["run"], ["us", "seq"], corrections.correction(RULES)))
    return corrections.corrected(at, verdicts.where("verdict in ('small', 'large', 'moved')").withColumn("seq", F.col("us")), DAY, SPAN)


#: From an arrival number on: values half as large again, no clicks, a noisier filter.
BRANCHES = {"scaled": 0.4, "no_clicks": 0.6, "noisy": 0.6}


@query()
def branch_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the sequential runner in three branches, each started from the last snapshot before it departs."""
    msgs = series(spark, sf_dir, "click", "view")
    last = msgs.agg(F.max("seq")).first()[0] or 0
    width = max(1, last // 16)
    base, changed = runner.Settings(), {"noisy": runner.Settings(noise=900.0)}
    kept = cut(folds.states(folds.fold(msgs, ["run"], ["seq"], runner.as_fold(base), folds.bucket_of("seq", width)), ["run"]))
    at = F.create_map(*(x for b, share in BRANCHES.items() for x in (F.lit(b), F.lit(int(share * last)))))
    plan = msgs.select("run").distinct().select("run", F.explode(F.array(*map(F.lit, BRANCHES))).alias("branch")).withColumn("at", at[F.col("branch")].cast("long"))

    def alter(d: DataFrame) -> DataFrame:
        value = F.when(F.col("changed") & (F.col("branch") == "scaled"), F.col("value") * 1.5).otherwise(F.col("value"))
        return d.withColumn("value", value).where(~(F.col("changed") & (F.col("branch") == "no_clicks") & (F.col("topic") == "click")))

    return folds.branches(msgs, kept, ["run"], ["seq"], "seq", width, runner.as_fold(base, changed), plan, alter)


SLIPS = slips.SlipRules(("click", "view"), live=96 * HOUR, longest=300 * HOUR, jump=20, least_share=0.1, least_value=5, standstill=15, moving=20, returns=12, settled=6, agree=120 * HOUR, noise_time=120 * HOUR, noise_weight=0.25)

AXLES = ("click", "view")


def slip_sql(r: slips.SlipRules) -> str:
    """The automaton row by row: marks by windows, the state by recursion over the rows of a run."""
    per = lambda text, sep=" AND ": sep.join(text.format(a=a) for a in AXLES)
    live = {a: f"coalesce(us - u_{a} <= {r.live}, false)" for a in AXLES}
    marks = ", ".join(
        f"last_value(CASE WHEN topic = '{a}' THEN us END IGNORE NULLS) OVER w AS u_{a}, last_value(CASE WHEN topic = '{a}' THEN z END IGNORE NULLS) OVER w AS z_{a}, last_value(CASE WHEN topic = '{a}' THEN h END IGNORE NULLS) OVER w AS h_{a}, "
        f"last_value(CASE WHEN topic = '{a}' AND side <> 0 THEN us END IGNORE NULLS) OVER w AS ju_{a}, last_value(CASE WHEN topic = '{a}' AND side <> 0 THEN side END IGNORE NULLS) OVER w AS js_{a}, last_value(CASE WHEN topic = '{a}' AND side <> 0 THEN abs(dz) END IGNORE NULLS) OVER w AS jm_{a}, "
        + ", ".join(f"max(CASE WHEN topic = '{a}' AND side = {-s} THEN us END) OVER w AS back_{n}_{a}, max(CASE WHEN topic = '{a}' AND {-s} * dz > {r.returns} THEN us END) OVER w AS high_{n}_{a}" for n, s in (("up", 1), ("down", -1)))
        for a in AXLES
    )
    homes = ", ".join(f"max(CASE WHEN topic = '{a}' AND {-s} * dz < {r.settled} THEN high_{n}_{a} END) OVER w AS home_{n}_{a}" for a in AXLES for n, s in (("up", 1), ("down", -1)))
    lives = ", ".join(f"{live[a]} AS l_{a}" for a in AXLES)
    back = lambda n: per(f"(NOT m.l_{{a}} OR coalesce(greatest(m.back_{n}_{{a}}, m.home_{n}_{{a}}) > r.since_us, false))")
    return f"""WITH RECURSIVE {S},
v AS (SELECT run, topic, seq, us, value AS z, coalesce((lag(value, 1) OVER x + lag(value, 2) OVER x) / 2, 50.0) AS h FROM s WHERE topic IN ('click', 'view') AND value IS NOT NULL WINDOW x AS (PARTITION BY run, topic ORDER BY us, seq)),
d AS (SELECT *, abs(z - h) <= 45 AS ok, CASE WHEN us - lag(us) OVER x <= {r.live} THEN z - lag(z) OVER x - (h - lag(h) OVER x) END AS dz, row_number() OVER (PARTITION BY run ORDER BY us, seq) AS i FROM v WINDOW x AS (PARTITION BY run, topic ORDER BY us, seq)),
e AS (SELECT *, CASE WHEN dz >= {r.jump} THEN 1 WHEN dz <= -{r.jump} THEN -1 ELSE 0 END AS side, coalesce(lag(ok) OVER (PARTITION BY run ORDER BY us, seq), false) AS ok_before FROM d),
f AS (SELECT *, {marks}, avg(CASE WHEN side = 0 THEN abs(dz) END) OVER (PARTITION BY run ORDER BY us RANGE BETWEEN {r.noise_time} PRECEDING AND CURRENT ROW) AS noise, CASE WHEN ok THEN max(CASE WHEN ok AND NOT ok_before THEN us END) OVER w END AS since FROM e WINDOW w AS (PARTITION BY run ORDER BY us, seq ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, {homes}, {lives} FROM f WINDOW w AS (PARTITION BY run ORDER BY us, seq ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, {per("l_{a}::INT", " + ")} AS live, ({per("CASE WHEN l_{a} THEN h_{a} ELSE 0 END", " + ")}) / ({per("l_{a}::INT", " + ")}) AS level, {per("(NOT l_{a} OR z_{a} < " + str(r.standstill) + ")")} AS still, coalesce({per("CASE WHEN l_{a} THEN js_{a} END", ", ")}) AS sign,
least({per("CASE WHEN l_{a} THEN jm_{a} ELSE 1e300 END", ", ")}) AS size, least({per("CASE WHEN l_{a} THEN ju_{a} ELSE 4611686018427387904 END", ", ")}) AS oldest FROM g),
m AS MATERIALIZED (SELECT *, coalesce(live >= 2 AND {per("(NOT l_{a} OR us - ju_{a} <= " + str(r.live) + ")")} AND {per("(NOT l_{a} OR (js_{a} = sign AND sign * (z_{a} - h_{a}) > 0))")} AND size >= {r.least_share} * level AND level > {r.least_value} AND NOT still, false) AS entry, coalesce(live > 0 AND still AND level > {r.moving}, false) AS zeros FROM k),
r AS (SELECT run, 0::BIGINT AS i, 0 AS slip, NULL::BIGINT AS since_us, NULL::DOUBLE AS size, -9000000000000000000 AS last_end, 0 AS t_sign, -9000000000000000000 AS t_at, NULL::BIGINT AS o_us, NULL::VARCHAR AS how FROM (SELECT DISTINCT run FROM m)
UNION ALL SELECT q.run, q.i, q.slip, q.since_us, q.size, q.last_end, CASE WHEN q.how = 'timeout' THEN q.was ELSE q.t_sign END, CASE WHEN q.how = 'timeout' THEN q.us ELSE q.t_at END, q.us, q.how FROM (
SELECT m.run, m.i, m.us, r.slip AS was, r.t_sign, r.t_at, CASE WHEN x.how IS NOT NULL THEN 0 WHEN r.slip <> 0 THEN r.slip WHEN x.enters THEN m.sign ELSE 0 END AS slip, CASE WHEN r.slip <> 0 THEN r.since_us WHEN x.enters THEN m.us END AS since_us, CASE WHEN r.slip <> 0 THEN r.size WHEN x.enters THEN m.size END AS size, CASE WHEN x.how IS NOT NULL THEN m.us ELSE r.last_end END AS last_end, x.how
FROM r JOIN m ON m.run = r.run AND m.i = r.i + 1, LATERAL (SELECT CASE WHEN r.slip = 0 THEN NULL WHEN m.us - r.since_us > {r.longest} THEN 'timeout' WHEN m.zeros THEN 'zeros' WHEN {r.jump} + {r.noise_weight} * m.noise >= r.size THEN 'noise'
WHEN m.live > 0 AND ((r.slip > 0 AND {back("up")}) OR (r.slip < 0 AND {back("down")})) THEN 'back' WHEN m.us - greatest(m.since, r.since_us) >= {r.agree} AND m.since IS NOT NULL THEN 'agree' END AS how,
r.slip = 0 AND m.entry AND m.oldest > r.last_end AND NOT (r.t_sign = -m.sign AND m.us - r.t_at <= {r.longest}) AS enters) x) q),
h AS (SELECT run, since_us, how, o_us, size FROM r WHERE how IS NOT NULL), b AS (SELECT run, slip, since_us, any_value(size) AS size FROM r WHERE slip <> 0 GROUP BY 1, 2, 3)
SELECT b.run, b.since_us AS us, b.slip AS sign, round(b.size, 6) AS size, h.o_us AS end, h.how FROM b LEFT JOIN h ON h.run = b.run AND h.since_us = b.since_us"""


@query(slip_sql(SLIPS))
def joint_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("run", "topic").orderBy("us", "seq")
    d = series(spark, sf_dir, *AXLES).where("value is not null")
    d = d.withColumn("expected", F.coalesce((F.lag("value", 1).over(w) + F.lag("value", 2).over(w)) / 2, F.lit(50.0)))
    d = d.select("run", "us", "seq", F.col("topic").alias("axle"), F.col("value").alias("z"), "expected", (F.abs(F.col("value") - F.col("expected")) <= 45).alias("ok"))
    return slips.slips(d, SLIPS, 20 * DAY).withColumn("size", F.round("size", 6))


# ---- scenarios and arms

#: Which messages behind the departure stay, and how the runner is set.
SCENARIOS = {"all": "true", "no_clicks": "topic <> 'click'", "thinned": "seq % 3 = 0", "first_half": f"us % {SPAN} < {SPAN // 2}"}
ARMS = {"base": runner.Settings(), "noisy": runner.Settings(noise=900.0), "quick": runner.Settings(drift=400.0)}
DEPARTS = 0.3


def scenario_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, scenario, arm and the runner's rows behind the departure, all from one set of snapshots."""
    msgs = series(spark, sf_dir, "click", "view")
    last = msgs.agg(F.max("seq")).first()[0] or 0
    width = max(1, last // 16)
    kept = cut(folds.states(folds.fold(msgs.where(F.col("seq") < int(DEPARTS * last)), ["run"], ["seq"], runner.as_fold(ARMS["base"]), folds.bucket_of("seq", width)), ["run"]))
    names = [f"{s}/{a}" for s in SCENARIOS for a in ARMS]
    plan = msgs.select("run").distinct().select("run", F.explode(F.array(*map(F.lit, names))).alias("branch"), F.lit(int(DEPARTS * last)).cast("long").alias("at"))
    scenario = lambda: F.split_part("branch", F.lit("/"), F.lit(1))

    def alter(d: DataFrame) -> DataFrame:
        stays = F.lit(True)
        for name, rule in SCENARIOS.items():
            stays = F.when(scenario() == name, F.expr(rule)).otherwise(stays)
        return d.where(~F.col("changed") | stays)

    rows = folds.branches(msgs, kept, ["run"], ["seq"], "seq", width, runner.as_fold(ARMS["base"], {f"{s}/{a}": x for s in SCENARIOS for a, x in ARMS.items()}), plan, alter)
    return rows.select("run", scenario().alias("scenario"), F.split_part("branch", F.lit("/"), F.lit(2)).alias("arm"), "node", "us", "speed", "stale")


@query()
def scenario_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of every arm in every scenario against the values of signups, interpolated at the rows' times."""
    rows = cut(scenario_rows(spark, sf_dir))
    truth = series(spark, sf_dir, "signup").where("value is not null").groupBy("run", "us").agg(F.avg("value").alias("value"))
    at = timejoin.interpolate(rows.select("run", "us").distinct(), truth, "run", "us", "value", bucket=SPAN)
    scored = rows.join(at, ["run", "us"]).withColumn("e", F.col("speed") - F.col("interp_value"))
    scored = cut(scored.select("scenario", "arm", "e", "stale"))
    return stats.error_stats_of_few(scored, ["scenario", "arm"], "e", F.round(F.avg(F.col("stale").cast("int")), 6).alias("stale"))


GRID_U, GRID_V = [-0.05, -0.03, -0.01, 0.0, 0.01, 0.03, 0.05], [0.0, 5.0, 15.0, 25.0, 40.0, 50.0]


@query()
def fitted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tax of order lines over discount (less a twentieth) and quantity, smoothed and constrained on both sides of zero."""
    d = table(spark, sf_dir, "lineitem")
    w = tables.fitted_table(d, F.col("l_discount") - 0.05, F.col("l_quantity"), F.col("l_tax"), GRID_U, GRID_V)
    return tables.as_rows(spark, tables.sign_constrained(w, GRID_U), GRID_U, GRID_V)


# ---- alignment

ALIGN = alignment.AlignRules(window=5 * DAY, first="click", second="view", second_only_after=DAY, tolerance=12 * HOUR, base=(1.0, 60.0), moved=8.0, near=3.0, least_way=5.0)

_FIX = f"""WITH {S}, x AS (SELECT run, us, seq, topic AS antenna, sum(round(value, 2)::DECIMAL(18, 2)) OVER (PARTITION BY run ORDER BY us, seq ROWS UNBOUNDED PRECEDING)::DOUBLE / 10 AS way, value FROM s WHERE topic IN ('click', 'view') AND value IS NOT NULL),
f AS (SELECT run, us, antenna, way, way + seq % 7 AS x, value / 20 + CASE WHEN antenna = 'view' THEN 4 ELSE 0 END AS y FROM x), w AS (SELECT * FROM f QUALIFY us <= min(us) OVER (PARTITION BY run) + {5 * DAY}),
c AS (SELECT run, min(us) AS start, count(*) AS used, count(*) FILTER (antenna = 'click') AS n1, max(us) FILTER (antenna = 'view') - min(us) FILTER (antenna = 'view') AS span FROM w GROUP BY run),
o AS (SELECT w.* FROM w JOIN c USING (run) WHERE (n1 > 0 AND antenna = 'click') OR (n1 = 0 AND span >= {DAY})),
g AS (SELECT run, any_value(antenna) AS antenna, max(way) - min(way) > 8 AS moving, arg_max(x, us) AS lx, arg_max(y, us) AS ly, arg_max(way, us) AS way, arg_min(x, us) AS fx, arg_min(y, us) AS fy, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM o GROUP BY run),
d AS (SELECT o.*, sqrt((x - mx) ** 2 + (y - my) ** 2) AS away FROM o JOIN g USING (run)), k AS (SELECT run, avg(x) AS x, avg(y) AS y FROM (SELECT *, min(away) OVER (PARTITION BY run) AS least FROM d) WHERE away <= least + 1e-6 OR away < 3 GROUP BY run),
p AS (SELECT a.run, sum(b.x - a.x) AS dx, sum(b.y - a.y) AS dy FROM w a JOIN w b ON a.run = b.run AND a.antenna = 'click' AND b.antenna = 'view' AND abs(a.us - b.us) <= {12 * HOUR} WHERE sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) BETWEEN 1 AND 60 GROUP BY a.run),
h AS (SELECT c.run, start, used, CASE WHEN moving THEN lx ELSE k.x END AS x, CASE WHEN moving THEN ly ELSE k.y END AS y, g.way, CASE WHEN dx IS NOT NULL THEN atan2(dx, dy) WHEN sqrt((lx - fx) ** 2 + (ly - fy) ** 2) > 5 THEN atan2(lx - fx, ly - fy) END AS heading, moving, antenna FROM c JOIN g USING (run) JOIN k USING (run) LEFT JOIN p USING (run))
SELECT run, start, used, round(x, 6) AS x, round(y, 6) AS y, round(way, 6) AS way, round(heading, 6) AS heading, heading IS NOT NULL AS ready, moving, antenna FROM h"""


def fixes_of_antennas(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("run").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    d = series(spark, sf_dir, "click", "view").where("value is not null").withColumn("way", F.sum(F.round("value", 2).cast("decimal(18,2)")).over(w).cast("double") / 10)
    y = F.col("value") / 20 + F.when(F.col("topic") == "view", 4).otherwise(0)
    return d.select("run", "us", F.col("topic").alias("antenna"), (F.col("way") + F.col("seq") % 7).alias("x"), y.alias("y"), "way")


@query(_FIX)
def alignment_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = alignment.in_batch(fixes_of_antennas(spark, sf_dir), ALIGN)
    return d.select("run", "start", "used", *(F.round(c, 6).alias(c) for c in ("x", "y", "way", "heading")), "ready", "moving", "antenna")
