"""Queries over the event series: joins in time, grids, windows, islands, statistics.

A run is a user, a topic an event type, stamps are microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import grid, islands, quantiles, running, stats, timejoin
from ..sources.tables import series, table

HOUR = 3_600_000_000
QUERIES, SQL = {}, {}

S = "s AS (SELECT user_id AS run, event_type AS topic, event_id AS seq, epoch_us(ts) AS us, value FROM events)"


def query(sql: str | None = None, on_series: bool = True):
    """Register a query under its function's name; its SQL may use the series s, and name further tables after a comma."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {S}{sql}" if on_series and sql.startswith(",") else f"WITH {S} {sql}" if on_series else sql
        return f

    return add


def topics(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [series(spark, sf_dir, n).drop("topic") for n in names]


# ---- joins in time


@query("""SELECT a.run, a.seq, a.us, b.us AS other_us, b.value AS other_value
FROM (SELECT * FROM s WHERE topic = 'click') a ASOF LEFT JOIN (SELECT * FROM s WHERE topic = 'view') b ON a.run = b.run AND a.us >= b.us""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = topics(spark, sf_dir, "click", "view")
    return timejoin.asof(a.drop("value"), b, "run", "us", ["value"], tie="seq", bucket=240 * HOUR)


@query("""SELECT a.run, a.seq, a.us, b.us AS other_us, b.value AS other_value
FROM (SELECT * FROM s WHERE topic = 'click') a ASOF LEFT JOIN (SELECT * FROM s WHERE topic = 'purchase') b ON a.run = b.run AND a.us <= b.us""")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = topics(spark, sf_dir, "click", "purchase")
    return timejoin.asof_forward(a.drop("value"), b, "run", "us", ["value"], tie="seq", bucket=240 * HOUR)


@query("""SELECT a.run, a.seq, a.us, coalesce(b.us, f.us) AS other_us, coalesce(b.value, f.value) AS other_value
FROM (SELECT * FROM s WHERE topic = 'click') a ASOF LEFT JOIN (SELECT * FROM s WHERE topic = 'view') b ON a.run = b.run AND a.us >= b.us
LEFT JOIN (SELECT run, min(us) AS us, arg_min(value, us) AS value FROM s WHERE topic = 'view' GROUP BY run) f ON a.run = f.run""")
def asof_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = topics(spark, sf_dir, "click", "view")
    return timejoin.asof(a.drop("value"), b, "run", "us", ["value"], "clamp", tie="seq")


@query("""SELECT a.run, a.seq, a.us, b.us AS other_us, coalesce(b.value, 0.0) AS other_value
FROM (SELECT * FROM s WHERE topic = 'click') a ASOF LEFT JOIN (SELECT * FROM s WHERE topic = 'view') b ON a.run = b.run AND a.us - 7200000000 >= b.us""")
def asof_lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = topics(spark, sf_dir, "click", "view")
    return timejoin.asof(a.drop("value"), b, "run", "us", ["value"], "zero", tie="seq", shift=2 * HOUR)


NEAREST = """, a AS (SELECT * FROM s WHERE topic = 'click'), b AS (SELECT * FROM s WHERE topic = '{right}'),
p AS (SELECT a.run, a.seq, a.us, b.us AS pus, b.value AS pv FROM a ASOF LEFT JOIN b ON a.run = b.run AND a.us >= b.us),
n AS (SELECT a.seq, b.us AS nus, b.value AS nv FROM a ASOF LEFT JOIN b ON a.run = b.run AND a.us < b.us),
c AS (SELECT run, p.seq, us, CASE WHEN pus IS NULL OR nus - us <= us - pus THEN coalesce(nus, pus) ELSE pus END AS other_us,
CASE WHEN pus IS NULL OR nus - us <= us - pus THEN coalesce(nv, pv) ELSE pv END AS other_value FROM p JOIN n USING (seq))
"""


@query(NEAREST.format(right="view") + "SELECT *, coalesce(abs(other_us - us) <= 21600000000, false) AS ok FROM c")
def nearest_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = topics(spark, sf_dir, "click", "view")
    return timejoin.nearest(a.drop("value"), b, "run", "us", ["value"], 6 * HOUR, "seq", 240 * HOUR)


@query("SELECT run, seq, us, us + 1000 AS other_us, 1 AS other_side, true AS ok FROM s WHERE topic = 'signup'")
def nearest_tie_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    (a,) = topics(spark, sf_dir, "signup")
    a = a.drop("value")
    sides = a.select("run", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"), "us").withColumn("us", F.col("us") + 1000 * F.col("side"))
    return timejoin.nearest(a, sides, "run", "us", ["side"], 1000, bucket=240 * HOUR)


@query(""", a AS (SELECT * FROM s WHERE topic = 'click'), b AS (SELECT * FROM s WHERE topic = 'view'),
p AS (SELECT a.run, a.seq, a.us, b.us AS t0, b.value AS v0 FROM a ASOF LEFT JOIN b ON a.run = b.run AND a.us >= b.us),
n AS (SELECT a.seq, b.us AS t1, b.value AS v1 FROM a ASOF LEFT JOIN b ON a.run = b.run AND a.us < b.us)
SELECT run, p.seq, us, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = us THEN v0 ELSE v0 + (v1 - v0) * ((us - t0) / (t1 - t0)) END, 6) AS interp_value FROM p JOIN n USING (seq)""")
def interp_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = topics(spark, sf_dir, "click", "view")
    return timejoin.interpolate(a.drop("value"), b, "run", "us", "value", "seq", 240 * HOUR).withColumn("interp_value", F.round("interp_value", 6))


@query(""", a AS (SELECT * FROM s WHERE topic = 'click'), b AS (SELECT * FROM s WHERE topic = 'view'),
p AS (SELECT a.run, a.seq, a.us, b.us AS t0 FROM a ASOF LEFT JOIN b ON a.run = b.run AND a.us >= b.us),
n AS (SELECT a.seq, b.us AS t1 FROM a ASOF LEFT JOIN b ON a.run = b.run AND a.us <= b.us)
SELECT run, p.seq, us, coalesce(us - t0 <= 43200000000 AND t1 - us <= 43200000000, false) AS fresh FROM p JOIN n USING (seq)""")
def fresh_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = topics(spark, sf_dir, "click", "view")
    return timejoin.fresh(a.drop("value"), b, "run", "us", 12 * HOUR, 240 * HOUR)


PAIR = """(SELECT run, seq AS {x}, CASE WHEN p IS NULL OR n - us <= us - p THEN coalesce(ns, ps) ELSE ps END AS {y}, CASE WHEN p IS NULL OR n - us <= us - p THEN coalesce(n, p) ELSE p END AS t, us FROM
(SELECT a.run, a.seq, a.us, b.us AS p, b.seq AS ps FROM {a} a ASOF LEFT JOIN {b} b ON a.run = b.run AND a.us >= b.us) JOIN (SELECT a.seq, b.us AS n, b.seq AS ns FROM {a} a ASOF LEFT JOIN {b} b ON a.run = b.run AND a.us < b.us) USING (seq))"""


@query(", a AS (SELECT * FROM s WHERE topic = 'click'), b AS (SELECT * FROM s WHERE topic = 'view') SELECT x.run, x.a_key, x.b_key FROM " + PAIR.format(x="a_key", y="b_key", a="a", b="b") + " x JOIN " + PAIR.format(x="b_key", y="a_key", a="b", b="a") + " y ON x.run = y.run AND x.a_key = y.a_key AND x.b_key = y.b_key WHERE abs(x.t - x.us) <= 21600000000")
def paired_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = topics(spark, sf_dir, "click", "view")
    return timejoin.mutual_pairs(a, b, "run", "us", "seq", 6 * HOUR, 240 * HOUR)


@query("SELECT a.run, a.seq AS a_seq, b.seq AS b_seq, b.us - a.us AS gap FROM s a JOIN s b ON a.run = b.run AND a.topic = 'click' AND b.topic = 'view' AND abs(a.us - b.us) <= 36000000000")
def band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = topics(spark, sf_dir, "click", "view")
    return timejoin.band_pairs(a, b, "run", "us", 10 * HOUR).select("a.run", F.col("a.seq").alias("a_seq"), F.col("b.seq").alias("b_seq"), (F.col("b.us") - F.col("a.us")).alias("gap"))


@query(""", r AS (SELECT a.run, b.us - a.us AS latency FROM (SELECT * FROM s WHERE topic = 'click') a ASOF LEFT JOIN (SELECT * FROM s WHERE topic = 'purchase') b ON a.run = b.run AND a.us <= b.us)
SELECT run, count(*) AS inputs, count(*) - count(latency) AS unanswered, min(latency) AS fastest, round(quantile_cont(latency, 0.5), 1) AS median FROM r GROUP BY run""")
def first_response_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = topics(spark, sf_dir, "click", "purchase")
    r = timejoin.first_response(a, b, "run", "us", 240 * HOUR)
    return r.groupBy("run").agg(F.count("*").alias("inputs"), (F.count("*") - F.count("latency")).alias("unanswered"), F.min("latency").alias("fastest"), F.round(F.percentile("latency", F.lit(0.5)), 1).alias("median"))


@query(""", o AS (SELECT * FROM s WHERE topic = 'purchase'), i AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq, us) AS k FROM s WHERE topic = 'click'),
h AS (SELECT o.run, o.seq, o.us, max(i.k) AS k FROM o LEFT JOIN i ON i.run = o.run AND i.seq <= o.seq GROUP BY 1, 2, 3)
SELECT h.run, h.seq, h.seq - arg_max(i.seq, struct_pack(us := i.us, seq := i.seq)) AS age FROM h LEFT JOIN i ON i.run = h.run AND i.k BETWEEN h.k - 63 AND h.k AND i.us <= h.us GROUP BY 1, 2""")
def input_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = topics(spark, sf_dir, "purchase", "click")
    return timejoin.freshest_of(a, b, "run", "us", "seq").select("run", "seq", "age")


# ---- grids

GRID = ", e AS (SELECT * FROM s WHERE topic = 'view'), g AS (SELECT run, unnest(range(min(us) // 21600000000, max(us) // 21600000000 + 1)) AS node FROM e GROUP BY run), n AS (SELECT run, node, node * 21600000000 AS us FROM g)"


@query(GRID + " SELECT n.run, n.node, n.us, e.value FROM n ASOF LEFT JOIN e ON n.run = e.run AND n.us >= e.us")
def grid_resample_locf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.locf(series(spark, sf_dir, "view"), "run", "us", "value", 6 * HOUR, "seq")


@query(GRID + """, p AS (SELECT n.*, e.us AS t0, e.value AS v0 FROM n ASOF LEFT JOIN e ON n.run = e.run AND n.us >= e.us), q AS (SELECT n.run, n.node, e.us AS t1, e.value AS v1 FROM n ASOF LEFT JOIN e ON n.run = e.run AND n.us < e.us)
SELECT run, node, us, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = us THEN v0 ELSE v0 + (v1 - v0) * ((us - t0) / (t1 - t0)) END, 6) AS value FROM p JOIN q USING (run, node)""")
def grid_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.interpolated(series(spark, sf_dir, "view"), "run", "us", "value", 6 * HOUR, "seq").withColumn("value", F.round("value", 6))


@query(""", d AS (SELECT *, us - lag(us) OVER w AS dt, value + lag(value) OVER w AS two FROM s WINDOW w AS (PARTITION BY run, topic ORDER BY us, seq))
SELECT run, topic, round(sum(0.5 * two * least(greatest(dt / 1e6, 0), 86400.0)), 3) AS area, round(sum(least(greatest(dt / 1e6, 0), 86400.0)), 3) AS seconds FROM d GROUP BY run, topic""")
def integrate_trapz(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = grid.steps(series(spark, sf_dir), ["run", "topic"], "us", "value", [F.col("us"), F.col("seq")], 86400)
    return d.groupBy("run", "topic").agg(F.round(F.sum("area"), 3).alias("area"), F.round(F.sum("dt"), 3).alias("seconds"))


@query("SELECT run, seq, round(sum(value) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING), 6) AS path FROM s")
def cumulative_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.cumulative(series(spark, sf_dir), ["run"], [F.col("seq")], "value", "path").select("run", "seq", F.round("path", 6).alias("path"))


@query("SELECT run, topic, seq, round((lead(value) OVER w - lag(value) OVER w) / ((lead(us) OVER w - lag(us) OVER w) / 1e6), 9) AS slope FROM s WINDOW w AS (PARTITION BY run, topic ORDER BY us)")
def centred_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.centred_difference(series(spark, sf_dir), ["run", "topic"], "us", "value").select("run", "topic", "seq", F.round("slope", 9).alias("slope"))


def glitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps th behind arrival tb by 50 ms, and some a thousand seconds off."""
    off = F.when(F.col("seq") % 7 == 0, F.lit(1_000_000_000)).otherwise(F.lit(50_000))
    return series(spark, sf_dir).withColumn("tb", F.col("us")).withColumn("th", F.col("us") - off)


GLITCHED = ", g AS (SELECT *, us AS tb, us - CASE WHEN seq % 7 = 0 THEN 1000000000 ELSE 50000 END AS th FROM s)"


@query(GLITCHED + ", m AS (SELECT *, quantile_cont(tb - th, 0.5) OVER (PARTITION BY run, topic) AS mid FROM g) SELECT run, seq, CASE WHEN abs(tb - th - mid) > 500000 THEN CAST(round(tb - mid) AS BIGINT) ELSE th END AS fixed FROM m")
def clock_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.corrected_clock(glitched(spark, sf_dir), ["run", "topic"], "tb", "th", 500_000).select("run", "seq", "fixed")


@query(", c AS (SELECT run, value, sum(value) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS path FROM s) SELECT run, CAST(floor(path / 250) AS BIGINT) AS bin, round(avg(value), 6) AS value FROM c GROUP BY 1, 2")
def path_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = grid.cumulative(series(spark, sf_dir), ["run"], [F.col("seq")], "value", "path")
    return grid.by_path(d, "run", "path", "value", 250).withColumn("value", F.round("value", 6))


@query(", q AS (SELECT *, CASE WHEN seq % 11 <> 0 THEN CAST(round(value * 10) AS BIGINT) END AS quant FROM s) SELECT run, topic, seq, quant, quant - coalesce(last_value(quant IGNORE NULLS) OVER (PARTITION BY run, topic ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS delta FROM q")
def delta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = series(spark, sf_dir).withColumn("value", F.when(F.col("seq") % 11 != 0, F.col("value")))
    return grid.delta_encoded(d, ["run", "topic"], [F.col("seq")], "value", 10).select("run", "topic", "seq", "quant", "delta")


# ---- running windows


@query(""", d AS (SELECT *, us - lag(us) OVER (PARTITION BY run, topic ORDER BY seq) AS dt FROM s)
SELECT run, topic, count(*) AS n, min(us) AS first_us, max(us) AS last_us, min(dt) AS dt_min, max(dt) AS dt_max, round(avg(dt), 3) AS dt_mean, round(quantile_cont(dt, 0.5), 3) AS dt_median,
count(*) FILTER (dt < 0) AS backward, count(*) FILTER (dt = 0) AS duplicate, count(*) FILTER (dt > 86400000000) AS gaps FROM d GROUP BY run, topic""")
def topic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = running.lags(series(spark, sf_dir), ["run", "topic"], "seq", "us")
    return d.groupBy("run", "topic").agg(
        F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.min("dt").alias("dt_min"), F.max("dt").alias("dt_max"), F.round(F.avg("dt"), 3).alias("dt_mean"), F.round(F.percentile("dt", F.lit(0.5)), 3).alias("dt_median"),
        F.count_if(F.col("dt") < 0).alias("backward"), F.count_if(F.col("dt") == 0).alias("duplicate"), F.count_if(F.col("dt") > 24 * HOUR).alias("gaps"),
    )


@query(", t AS (SELECT run, topic, count(*) AS n FROM s GROUP BY run, topic) SELECT topic, count(*) AS runs_with, sum(n)::BIGINT AS messages, min(n) AS least, quantile_cont(n, 0.5) AS middle, max(n) AS most FROM t GROUP BY topic")
def topic_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = series(spark, sf_dir).groupBy("run", "topic").agg(F.count("*").alias("n"))
    return t.groupBy("topic").agg(F.count("*").alias("runs_with"), F.sum("n").alias("messages"), F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).alias("middle"), F.max("n").alias("most"))


@query(GLITCHED + ", p AS (SELECT *, max(th) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING) - th AS late FROM g) SELECT run, count(*) FILTER (late > 0) AS late_rows, max(late) AS worst, round(avg(late), 3) AS mean_late FROM p GROUP BY run")
def arrival_lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = running.lateness(glitched(spark, sf_dir), ["run"], "seq", "th")
    return d.groupBy("run").agg(F.count_if(F.col("late") > 0).alias("late_rows"), F.max("late").alias("worst"), F.round(F.avg("late"), 3).alias("mean_late"))


@query(", d AS (SELECT run, seq, us - lag(us) OVER (PARTITION BY run ORDER BY seq) AS dt FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY dt DESC, seq) AS rank FROM d WHERE dt IS NOT NULL) SELECT run, seq, dt, rank FROM r WHERE rank <= 5")
def gap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = running.lags(series(spark, sf_dir), ["run"], "seq", "us").where("dt is not null")
    return running.top(d, ["run"], [F.desc("dt"), F.col("seq")], 5).select("run", "seq", "dt", "rank")


@query("SELECT run, seq, round(CASE WHEN count(*) OVER w = 5 THEN quantile_cont(value, 0.5) OVER w ELSE value END, 6) AS median5 FROM s WINDOW w AS (PARTITION BY run ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def rolling_median5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running.rolling_median(series(spark, sf_dir), ["run"], "seq", "value", 2, "median5").select("run", "seq", F.round("median5", 6).alias("median5"))


@query("SELECT run, seq, round(avg(value) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS mean7 FROM s")
def rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running.rolling_mean(series(spark, sf_dir), ["run"], "seq", "value", 3, "mean7").select("run", "seq", F.round("mean7", 6).alias("mean7"))


@query(", c AS (SELECT run, count(*) OVER (PARTITION BY run ORDER BY us RANGE BETWEEN CURRENT ROW AND 86400000000 FOLLOWING) AS ahead, us, max(us) OVER (PARTITION BY run) AS last FROM s) SELECT run, min(ahead) AS fewest, max(ahead) AS most FROM c WHERE us + 86400000000 <= last GROUP BY run")
def forward_window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = running.ahead_count(series(spark, sf_dir), ["run"], "us", 24 * HOUR).withColumn("last", F.max("us").over(Window.partitionBy("run")))
    return d.where(F.col("us") + 24 * HOUR <= F.col("last")).groupBy("run").agg(F.min("ahead").alias("fewest"), F.max("ahead").alias("most"))


@query(""", d AS (SELECT *, lag(value, 1) OVER w AS v1, lag(value, 2) OVER w AS v2, (us - lag(us, 1) OVER w) / (lag(us, 1) OVER w - lag(us, 2) OVER w) AS k FROM s WINDOW w AS (PARTITION BY run, topic ORDER BY us)),
m AS (SELECT *, abs(value - (v1 + (v1 - v2) * k)) / sqrt(1 + (1 + k) * (1 + k) + k * k) AS miss FROM d)
SELECT run, topic, seq, round(miss, 6) AS miss, round(1.4826 * quantile_cont(miss, 0.5) OVER (PARTITION BY run, topic ORDER BY us ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) AS noise FROM m""")
def second_diff_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = running.second_difference(series(spark, sf_dir), ["run", "topic"], "us", "value")
    return d.select("run", "topic", "seq", F.round("miss", 6).alias("miss"), F.round("noise", 6).alias("noise"))


@query(""", w AS (SELECT run, us, min(value) OVER r AS lo, max(value) OVER r AS hi, count(value) OVER r AS n, min(us) OVER (PARTITION BY run) AS a, max(us) OVER (PARTITION BY run) AS b FROM s WINDOW r AS (PARTITION BY run ORDER BY us RANGE BETWEEN CURRENT ROW AND 86400000000 FOLLOWING))
SELECT run, min(us) AS start FROM w WHERE lo > 5 AND hi < 120 AND n >= 2 AND us >= a + 36000000000 AND us + 86400000000 <= b - 36000000000 GROUP BY run""")
def choose_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running.first_window(series(spark, sf_dir), "run", "us", "value", 24 * HOUR, 10 * HOUR, 10 * HOUR, lambda lo, hi, n: (lo > 5) & (hi < 120) & (n >= 2))


@query(", o AS (SELECT run, list(value ORDER BY seq) AS v FROM s GROUP BY run) SELECT run, len(v) AS n, round(list_reduce(v, lambda a, x: a + 0.2 * (x - a)), 6) AS ewma FROM o")
def ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running.ewma(series(spark, sf_dir), ["run"], "seq", "value", 0.2).withColumn("ewma", F.round("ewma", 6))


@query("SELECT run, seq, round(sum(value * (1 + seq % 5)) OVER w / sum(value) OVER w, 6) AS scale FROM s WINDOW w AS (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def online_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = series(spark, sf_dir).withColumn("ratio", 1 + F.col("seq") % 5)
    return running.online_scale(d, ["run"], "seq", "value", "ratio").select("run", "seq", F.round("scale", 6).alias("scale"))


@query("SELECT run, seq, round(quantile_cont(value, 0.5) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS prefix_median FROM s")
def prefix_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running.prefix_median(series(spark, sf_dir), ["run"], "seq", "value", 30).select("run", "seq", F.round("prefix_median", 6).alias("prefix_median"))


# ---- islands

ISLANDS = ", f AS (SELECT *, {flag} AS flag FROM {source}), c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR flag <> lag(flag) OVER w THEN 1 ELSE 0 END AS b FROM f WINDOW w AS (PARTITION BY run ORDER BY {order})), i AS (SELECT *, sum(b) OVER (PARTITION BY run ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS island FROM c)"


@query(ISLANDS.format(flag="value > 50", source="s", order="seq") + " SELECT run, island::BIGINT AS island, min(us) AS start, max(us) AS \"end\", count(*) AS rows FROM i WHERE flag GROUP BY run, island")
def islands_true_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.true_runs(series(spark, sf_dir), ["run"], [F.col("seq")], F.col("value") > 50)


@query(", d AS (SELECT *, us - lag(us) OVER (PARTITION BY run ORDER BY us) > 86400000000 AS gap FROM s), n AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM d) SELECT run, session::BIGINT AS session, min(us) AS start, max(us) AS \"end\", count(*) AS rows, count(DISTINCT topic) AS topics FROM n GROUP BY run, session")
def sessions_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = islands.sessions(series(spark, sf_dir), ["run"], [F.col("us")], 24 * HOUR)
    return d.groupBy("run", "session").agg(F.min("us").alias("start"), F.max("us").alias("end"), F.count("*").alias("rows"), F.count_distinct("topic").alias("topics"))


@query(""", v AS (SELECT *, CAST(floor(value / 40) AS BIGINT) AS level FROM s), c AS (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER w THEN 1 ELSE 0 END AS b FROM v WINDOW w AS (PARTITION BY run ORDER BY us)),
i AS (SELECT *, sum(b) OVER (PARTITION BY run ORDER BY us ROWS UNBOUNDED PRECEDING) AS island FROM c) SELECT run, level, min(us) AS start, max(us) - min(us) AS span, count(*) AS rows FROM i WHERE level <> 0 GROUP BY run, island, level HAVING max(us) - min(us) >= 28800000000""")
def stuck_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = series(spark, sf_dir).withColumn("level", F.floor(F.col("value") / 40))
    order = [F.col("us")]
    d = islands.numbered(d.withColumn("new", islands.changed(["run"], order, "level")), ["run"], order, F.col("new"))
    g = d.where("level <> 0").groupBy("run", "island", "level").agg(F.min("us").alias("start"), (F.max("us") - F.min("us")).alias("span"), F.count("*").alias("rows"))
    return g.where(F.col("span") >= 8 * HOUR).drop("island")


@query(ISLANDS.format(flag="value < 30 AND coalesce(other, 0) > 40", source="(SELECT a.*, b.value AS other FROM (SELECT * FROM s WHERE topic = 'click') a ASOF LEFT JOIN (SELECT * FROM s WHERE topic = 'view') b ON a.run = b.run AND a.us >= b.us)", order="us") + " SELECT run, island::BIGINT AS island, min(us) AS start, max(us) AS \"end\", count(*) AS rows, round(max(other), 6) AS other_max FROM i WHERE flag GROUP BY run, island")
def low_while_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = topics(spark, sf_dir, "click", "view")
    d = timejoin.asof(a, b, "run", "us", ["value"], tie="seq")
    return islands.true_runs(d, ["run"], [F.col("us")], (F.col("value") < 30) & (F.coalesce("other_value", F.lit(0.0)) > 40), F.round(F.max("other_value"), 6).alias("other_max"))


@query(ISLANDS.format(flag="coalesce(abs(value - other) > 30, false)", source="(SELECT a.*, b.value AS other FROM (SELECT * FROM s WHERE topic = 'click') a ASOF LEFT JOIN (SELECT * FROM s WHERE topic = 'view') b ON a.run = b.run AND a.us >= b.us)", order="us") + " SELECT run, min(us) AS start, count(*) AS rows, round(max(abs(value - other)), 6) AS worst, (list(seq ORDER BY round(abs(value - other), 6) DESC, seq))[1] AS at_seq FROM i WHERE flag GROUP BY run, island")
def disagree_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = topics(spark, sf_dir, "click", "view")
    d = timejoin.asof(a, b, "run", "us", ["value"], tie="seq").withColumn("miss", F.abs(F.col("value") - F.col("other_value")))
    g = islands.true_runs(d, ["run"], [F.col("us")], F.col("miss") > 30, F.round(F.max("miss"), 6).alias("worst"), F.max_by("seq", F.struct(F.round("miss", 6), -F.col("seq"))).alias("at_seq"))
    return g.drop("island", "end")


@query(ISLANDS.format(flag="value < 40", source="s", order="us") + " SELECT run, min(us) AS start, max(us) - min(us) AS span, round(quantile_cont(value, 0.5), 6) AS middle FROM i WHERE flag GROUP BY run, island HAVING max(us) - min(us) >= 57600000000")
def dwell_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = islands.true_runs(series(spark, sf_dir), ["run"], [F.col("us")], F.col("value") < 40, F.round(F.percentile("value", F.lit(0.5)), 6).alias("middle"))
    return g.where(F.col("end") - F.col("start") >= 16 * HOUR).select("run", "start", (F.col("end") - F.col("start")).alias("span"), "middle")


@query(", d AS (SELECT *, us - lag(us) OVER (PARTITION BY run ORDER BY us) > 7200000000 AS gap FROM s), n AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY us ROWS UNBOUNDED PRECEDING) AS burst FROM d), b AS (SELECT run, burst, count(*) AS size FROM n GROUP BY run, burst) SELECT run, max(size) AS largest, count(*) FILTER (size >= 3) AS bursts FROM b GROUP BY run")
def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = islands.sessions(series(spark, sf_dir), ["run"], [F.col("us")], 2 * HOUR).groupBy("run", "session").agg(F.count("*").alias("size"))
    return b.groupBy("run").agg(F.max("size").alias("largest"), F.count_if(F.col("size") >= 3).alias("bursts"))


@query(ISLANDS.format(flag="value <= 60", source="s", order="us") + ", r AS (SELECT run, min(us) AS start FROM i WHERE flag GROUP BY run, island HAVING max(us) - min(us) >= 86400000000) SELECT run, min(start) AS start FROM r GROUP BY run")
def recovery_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.recovery(series(spark, sf_dir), ["run"], F.col("value") <= 60, 24 * HOUR)


@query(""", m AS (SELECT *, CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'mid' ELSE 'high' END AS mode FROM s), c AS (SELECT *, CASE WHEN mode IS DISTINCT FROM lag(mode) OVER w THEN 1 ELSE 0 END AS b FROM m WINDOW w AS (PARTITION BY run ORDER BY us)),
i AS (SELECT *, sum(b) OVER (PARTITION BY run ORDER BY us ROWS UNBOUNDED PRECEDING) AS island FROM c), h AS (SELECT *, CASE WHEN us - min(us) OVER (PARTITION BY run, island) >= 21600000000 THEN mode END AS held FROM i)
SELECT run, seq, mode, last_value(held IGNORE NULLS) OVER (PARTITION BY run ORDER BY us ROWS UNBOUNDED PRECEDING) AS confirmed FROM h""")
def mode_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("value") < 20, "low").when(F.col("value") < 60, "mid").otherwise("high")
    return islands.debounced(series(spark, sf_dir).withColumn("mode", mode), ["run"], "mode", 6 * HOUR).select("run", "seq", "mode", "confirmed")


# ---- statistics

PAIRS = ", p AS (SELECT a.run, a.us, a.value AS ref, b.value AS est, a.value - b.value AS e FROM (SELECT * FROM s WHERE topic = 'click') a ASOF LEFT JOIN (SELECT * FROM s WHERE topic = 'view') b ON a.run = b.run AND a.us >= b.us)"
ERRORS = "count(e) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(avg(e), 6) AS bias, round(quantile_cont(abs(e), 0.95), 6) AS p95, round(max(abs(e)), 6) AS worst, round(quantile_cont(abs(e), 0.5), 6) AS median"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = topics(spark, sf_dir, "click", "view")
    d = timejoin.asof(a, b, "run", "us", ["value"], tie="seq")
    return d.select("run", "us", F.col("value").alias("ref"), F.col("other_value").alias("est"), (F.col("value") - F.col("other_value")).alias("e"))


@query(PAIRS + f" SELECT run, {ERRORS} FROM p GROUP BY run")
def error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).groupBy("run").agg(*stats.error_stats(F.col("e")))


@query("SELECT topic, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max FROM s GROUP BY topic")
def dist_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, names = series(spark, sf_dir), {0.5: "p50", 0.95: "p95", 0.99: "p99"}
    whole = d.groupBy("topic").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("max"))
    shares = quantiles.side_by_side(quantiles.order_statistics(d, ["topic"], "value", list(names)), ["topic"], names)
    return whole.join(shares, "topic", "left").select("topic", "n", "mean", *(F.round(n, 6).alias(n) for n in names.values()), "max")


@query(PAIRS + " SELECT run, round(avg(CAST(abs(e) <= (10 + 0.5 * est) AS INT)), 6) AS within_1, round(avg(CAST(abs(e) <= 2 * (10 + 0.5 * est) AS INT)), 6) AS within_2 FROM p GROUP BY run")
def coverage_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigma = 10 + 0.5 * F.col("est")
    return pairs(spark, sf_dir).groupBy("run").agg(*(F.round(stats.coverage(F.col("e"), sigma, k), 6).alias(f"within_{k}") for k in (1, 2)))


@query(PAIRS + f", f AS (SELECT *, CASE WHEN ref < 5 THEN 'standstill' WHEN coalesce(est - 50, 0) > 0 THEN 'traction' WHEN coalesce(est - 50, 0) < 0 THEN 'brake' ELSE 'coast' END AS phase FROM p) SELECT phase, round(count(*) / sum(count(*)) OVER (), 6) AS share, {ERRORS} FROM f GROUP BY phase")
def phase_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pairs(spark, sf_dir)
    g = d.groupBy(stats.phase(F.col("ref") * 0.04, F.col("est") - 50).alias("phase")).agg(F.count("*").alias("_n"), *stats.error_stats(F.col("e")))
    # four rows at most are summed
    return g.withColumn("share", F.round(F.col("_n") / F.sum("_n").over(Window.partitionBy(F.lit(1))), 6)).drop("_n")


PER_RUN = PAIRS + ", r AS (SELECT run, count(e) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, CASE WHEN count(e) > 10 THEN max(abs(e)) END AS worst FROM p GROUP BY run)"


def per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    return pairs(spark, sf_dir).groupBy("run").agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(F.count(e) > 10, F.max(F.abs(e))).alias("worst"))


@query(PER_RUN + " SELECT count(*) FILTER (n > 0) AS runs, count(*) FILTER (n = 0) AS runs_empty, sum(n)::BIGINT AS pairs, round(sum(mae * n) / sum(n) FILTER (mae IS NOT NULL), 6) AS mae, round(sqrt(sum(rmse * rmse * n) / sum(n) FILTER (rmse IS NOT NULL)), 6) AS rmse, round(sum(worst * n) / sum(n) FILTER (worst IS NOT NULL), 6) AS worst FROM r")
def weighted_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    return per_run(spark, sf_dir).agg(
        F.count_if(n > 0).alias("runs"), F.count_if(n == 0).alias("runs_empty"), F.sum("n").alias("pairs"), F.round(stats.weighted_mean(F.col("mae"), n), 6).alias("mae"),
        F.round(stats.weighted_rms(F.col("rmse"), n), 6).alias("rmse"), F.round(stats.weighted_mean(F.col("worst"), n), 6).alias("worst"),
    )


@query(PER_RUN + ", a AS (SELECT round(avg(mae), 6) AS mean_of_runs FROM r) SELECT mean_of_runs, (SELECT round(avg(abs(e)), 6) FROM p) AS pooled FROM a")
def pooled_vs_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = per_run(spark, sf_dir)
    return sums.agg(F.round(F.avg("mae"), 6).alias("mean_of_runs"), F.round(F.sum(F.col("mae") * F.col("n")) / F.sum("n"), 6).alias("pooled"))


@query("SELECT run % 10 AS grp, topic, GROUPING(run % 10) AS all_grp, GROUPING(topic) AS all_topic, count(*) AS n, round(avg(value), 6) AS mean FROM s GROUP BY GROUPING SETS ((run % 10, topic), (run % 10), (topic), ())")
def multi_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = series(spark, sf_dir).withColumn("grp", F.col("run") % 10)
    g = d.cube("grp", "topic").agg(F.grouping("grp").cast("long").alias("all_grp"), F.grouping("topic").cast("long").alias("all_topic"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return g


@query(", h AS (SELECT CAST(CAST(floor(value / 25) AS BIGINT) AS VARCHAR) AS key, count(*) AS n FROM s GROUP BY 1) SELECT key, n AS total FROM h")
def packed_histogram_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = series(spark, sf_dir).groupBy("run", F.floor(F.col("value") / 25).alias("k")).agg(F.count("*").alias("n"))
    packed = h.groupBy("run").agg(F.concat_ws(";", F.collect_list(F.concat_ws(":", F.col("k").cast("string"), F.col("n").cast("string")))).alias("packed"))
    return stats.merged_histogram(packed, "packed")


@query("SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS xbin, CAST(floor(l_discount * 50) AS BIGINT) AS ybin, count(l_extendedprice) AS n, CASE WHEN count(l_extendedprice) >= 200 THEN round(quantile_cont(l_extendedprice, 0.5), 6) END AS median FROM lineitem GROUP BY 1, 2", on_series=False)
def binned_median_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.binned_median(table(spark, sf_dir, "lineitem"), F.floor(F.col("l_quantity") / 10), F.floor(F.col("l_discount") * 50), "l_extendedprice", 200)


@query(", b AS (SELECT topic, run % 12 AS bin, sum(value * value) AS q, sum(value) AS t, count(value) AS n FROM s GROUP BY 1, 2) SELECT topic, round(sum(q - t * t / n) / sum(n), 4) AS residual FROM b GROUP BY topic")
def residual_variance_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.within_bins(series(spark, sf_dir), ["topic"], F.col("run") % 12, "value").withColumn("residual", F.round("residual", 4))


@query(GLITCHED + ", o AS (SELECT *, (tb - th) / 1e6 AS off FROM g) SELECT topic, round(quantile_cont(off, 0.5), 6) AS middle, round(min(off), 6) AS least, round(quantile_cont(off, 0.01), 6) AS p01, round(quantile_cont(off, 0.99), 6) AS p99, round(stddev_pop(off), 4) AS spread, round(avg(CAST(th % 1000 = 0 AS INT)), 6) AS whole FROM o GROUP BY topic")
def robust_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = (F.col("tb") - F.col("th")) / 1e6
    p = lambda q: F.round(F.percentile(off, F.lit(q)), 6)
    return glitched(spark, sf_dir).groupBy("topic").agg(p(0.5).alias("middle"), F.round(F.min(off), 6).alias("least"), p(0.01).alias("p01"), p(0.99).alias("p99"), F.round(F.stddev_pop(off), 4).alias("spread"), F.round(F.avg((F.col("th") % 1000 == 0).cast("int")), 6).alias("whole"))


@query("SELECT topic, round(regr_slope(value, (us - 1704067200000000) / 86400e6), 5) AS slope, round(regr_intercept(value, (us - 1704067200000000) / 86400e6), 5) AS intercept, round(regr_r2(value, (us - 1704067200000000) / 86400e6), 6) AS r2 FROM s GROUP BY topic")
def linear_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = (F.col("us") - 1_704_067_200_000_000) / 86400e6
    g = series(spark, sf_dir).groupBy("topic").agg(*stats.trend(F.col("value"), days))
    return g.select("topic", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("SELECT run, count(*) FILTER (topic = 'click') AS click, count(*) FILTER (topic = 'error') AS error, count(*) FILTER (topic = 'purchase') AS purchase, count(*) FILTER (topic = 'signup') AS signup, count(*) FILTER (topic = 'view') AS view FROM s GROUP BY run")
def topic_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["click", "error", "purchase", "signup", "view"]
    return series(spark, sf_dir).groupBy("run").pivot("topic", names).count().na.fill(0, names)


@query(PER_RUN + " SELECT run, CASE WHEN n < 5 THEN 'NOT COUNTED' WHEN mae <= 45 AND worst <= 200 THEN 'PASS' ELSE 'FAIL' END AS verdict, concat_ws('; ', CASE WHEN mae > 45 THEN 'mean' END, CASE WHEN worst > 200 THEN 'worst' END) AS why FROM r")
def run_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mae, worst = F.col("mae"), F.col("worst")
    verdict = F.when(F.col("n") < 5, "NOT COUNTED").when((mae <= 45) & (worst <= 200), "PASS").otherwise("FAIL")
    return per_run(spark, sf_dir).select("run", verdict.alias("verdict"), F.concat_ws("; ", F.when(mae > 45, "mean"), F.when(worst > 200, "worst")).alias("why"))


@query(", a AS (SELECT run, round(avg(value), 6) AS v FROM s WHERE topic = 'click' GROUP BY run), b AS (SELECT run, round(avg(value), 6) AS v FROM s WHERE topic = 'view' GROUP BY run) SELECT run, a.v AS before, b.v AS after, round(b.v - a.v, 6) AS change FROM a FULL JOIN b USING (run)")
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda topic, name: series(spark, sf_dir, topic).groupBy("run").agg(F.round(F.avg("value"), 6).alias(name))
    return mean("click", "before").join(mean("view", "after"), "run", "full").withColumn("change", F.round(F.col("after") - F.col("before"), 6))


# ---- the baseline estimator

BASE = """, k AS (SELECT * FROM s WHERE topic IN ('click', 'view')), g AS (SELECT run, unnest(range(min(us) // 21600000000, max(us) // 21600000000 + 1)) AS node FROM k GROUP BY run), n AS (SELECT run, node, node * 21600000000 AS us FROM g),
c AS (SELECT n.*, e.us AS t1, e.value AS v1 FROM n ASOF LEFT JOIN (SELECT * FROM s WHERE topic = 'click') e ON n.run = e.run AND n.us >= e.us),
d AS (SELECT c.*, e.us AS t2, e.value AS v2 FROM c ASOF LEFT JOIN (SELECT * FROM s WHERE topic = 'view') e ON c.run = e.run AND c.us >= e.us),
f AS (SELECT run, node, us, CASE WHEN us - t1 <= 172800000000 THEN v1 END AS a, CASE WHEN us - t2 <= 172800000000 THEN v2 END AS b FROM d),
w AS (SELECT run, node, us, (coalesce(a, 0) + coalesce(b, 0)) / nullif((CASE WHEN a IS NULL THEN 0 ELSE 1 END) + (CASE WHEN b IS NULL THEN 0 ELSE 1 END), 0) AS speed FROM f),
b AS (SELECT *, sum(coalesce(speed, 0) * 6) OVER (PARTITION BY run ORDER BY node ROWS UNBOUNDED PRECEDING) AS path FROM w)"""


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, node, us, speed, path: on a grid, the mean of those of two topics that are fresh, and its integral."""
    both = series(spark, sf_dir, "click", "view")
    at = grid.nodes(both, "run", "us", 6 * HOUR)
    for k, topic in enumerate(("click", "view")):
        at = timejoin.asof(at, both.where(F.col("topic") == topic).drop("topic"), "run", "us", ["value"], tie="seq")
        at = at.withColumn(f"v{k}", F.when(F.col("us") - F.col("other_us") <= 48 * HOUR, F.col("other_value"))).drop("other_us", "other_value")
    n = F.col("v0").isNotNull().cast("int") + F.col("v1").isNotNull().cast("int")
    speed = F.when(n > 0, (F.coalesce("v0", F.lit(0.0)) + F.coalesce("v1", F.lit(0.0))) / n)
    at = at.withColumn("speed", speed).withColumn("area", F.coalesce("speed", F.lit(0.0)) * 6)
    return grid.cumulative(at, ["run"], [F.col("node")], "area", "path").select("run", "node", "us", "speed", "path")


@query(BASE + " SELECT run, node, round(speed, 6) AS speed, round(path, 4) AS path FROM b")
def baseline_estimator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline(spark, sf_dir).select("run", "node", F.round("speed", 6).alias("speed"), F.round("path", 4).alias("path"))


@query(BASE + """, r AS (SELECT * FROM s WHERE topic = 'purchase'), p AS (SELECT r.run, r.seq, r.us, r.value, b.us AS t0, b.speed AS s0 FROM r ASOF LEFT JOIN b ON r.run = b.run AND r.us >= b.us), q AS (SELECT r.seq, b.us AS t1, b.speed AS s1 FROM r ASOF LEFT JOIN b ON r.run = b.run AND r.us < b.us),
z AS (SELECT run, value, CASE WHEN t0 IS NULL OR t1 - us <= us - t0 THEN coalesce(t1, t0) ELSE t0 END AS t, us, CASE WHEN t0 IS NULL OR t1 - us <= us - t0 THEN CASE WHEN t1 IS NULL THEN s0 ELSE s1 END ELSE s0 END AS speed FROM p JOIN q USING (seq)),
y AS (SELECT CASE WHEN value < 5 THEN 'standstill' WHEN value > 50 THEN 'traction' WHEN value < 50 THEN 'brake' ELSE 'coast' END AS phase, speed - value AS e FROM z WHERE abs(t - us) <= 10800000000) SELECT phase, """ + ERRORS + " FROM y GROUP BY phase")
def baseline_vs_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    (ref,) = topics(spark, sf_dir, "purchase")
    d = timejoin.nearest(ref, baseline(spark, sf_dir), "run", "us", ["speed"], 3 * HOUR).where("ok")
    phase = stats.phase(F.col("value") * 0.04, F.col("value") - 50)
    return d.groupBy(phase.alias("phase")).agg(*stats.error_stats(F.col("other_speed") - F.col("value")))
