"""Queries of the evaluation layer: selections, responses, sweeps, whole-run figures, faults scored together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import faults, grid, islands, rules, spatial, stats, timejoin
from ..sources.tables import run_list, series, table, typed
from .building import TRACK, tracks
from .events import HOUR, ISLANDS, S, pairs, topics
from .objects import DAY, FAULT_SQL, PLACE, POINTS, _F, clicks, fault_start, places, points

QUERIES, SQL = {}, {}
SPAN = 240 * HOUR


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column) -> Column:
    return F.round(c, 6)


# ---- runs and rows


@query(f"WITH {S} SELECT run, topic, count(*) AS rows, min(us) AS start, max(us) - min(us) AS duration, round(count(*) / sum(count(*)) OVER (PARTITION BY run), 6) AS share FROM s GROUP BY run, topic")
def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_list(series(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query("SELECT event_id, event_type AS topic, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type = 'view' AND TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 AS far FROM events WHERE event_type IN ('click', 'view')")
def typed_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = typed(table(spark, sf_dir, "events"), "event_type", "props", {"click": "k long", "view": "k long"})
    return d.select("event_id", F.col("event_type").alias("topic"), "k", ((F.col("event_type") == "view") & (F.col("k") > 50)).alias("far"))


@query("SELECT vec_id, CAST(CASE WHEN len(embedding) < 60 OR label = 3 THEN 0 ELSE len(embedding) // 4 END AS INTEGER) AS rows, CASE WHEN len(embedding) < 60 OR label = 3 THEN NULL ELSE round(embedding[5]::DOUBLE, 6) END AS first FROM embeddings")
def array_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    rows = rules.shaped(F.when(F.col("label") != 3, F.col("embedding")), 4, 60)
    return e.select("vec_id", F.size(rows).alias("rows"), F.round(F.get(F.get(rows, F.lit(1)), F.lit(0)).cast("double"), 6).alias("first"))


@query(f"WITH {S} SELECT run, count(*) AS rows, count(*) FILTER (topic <> 'purchase' AND value IS NOT NULL AND isfinite(value) AND seq % 5 <> 0) AS published FROM s GROUP BY run")
def published_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = series(spark, sf_dir)
    ok = rules.valid_row((F.col("topic") != "purchase") & (F.col("seq") % 5 != 0), F.col("value"))
    return d.groupBy("run").agg(F.count("*").alias("rows"), F.count_if(ok).alias("published"))


@query(f"WITH {S}, f AS (SELECT run, min(us) FILTER (topic = 'click') AS first FROM s GROUP BY run) SELECT topic, count(*) AS rows, round(sum(value), 4) AS total FROM s JOIN f USING (run) WHERE NOT (topic = 'view' AND coalesce(us >= first + 864000000000, false)) GROUP BY topic")
def log_filter_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rules.without_after(series(spark, sf_dir), "run", "us", "topic", ["view"], "click", 10 * DAY)
    return d.groupBy("topic").agg(F.count("*").alias("rows"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {S}, d AS (SELECT run, topic, seq - lag(seq) OVER (PARTITION BY run, topic ORDER BY seq) AS step FROM s) SELECT run, count(*) AS rows, coalesce(sum(greatest(step - 1, 0)), 0)::BIGINT AS lost, round(count(*) FILTER (topic = 'click') / count(*), 6) AS click_share FROM d GROUP BY run")
def lost_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("run", "topic").orderBy("seq")
    d = series(spark, sf_dir).withColumn("step", F.col("seq") - F.lag("seq").over(w))
    return d.groupBy("run").agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.greatest(F.col("step") - 1, F.lit(0))), F.lit(0)).alias("lost"), F.round(F.count_if(F.col("topic") == "click") / F.count("*"), 6).alias("click_share"))


# ---- joins

_A, _B = "(SELECT * FROM s WHERE topic = 'click')", "(SELECT * FROM s WHERE topic = 'view')"


@query(f"""WITH {S}, p AS (SELECT a.seq, a.run, a.us, b.us AS t FROM {_A} a ASOF LEFT JOIN (SELECT * FROM s WHERE topic = 'purchase') b ON a.run = b.run AND a.us <= b.us),
q AS (SELECT p.*, b.us AS u FROM p ASOF LEFT JOIN (SELECT * FROM s WHERE topic = 'purchase') b ON p.run = b.run AND p.seq <= b.seq)
SELECT run, seq, CASE WHEN t IS NOT NULL AND u IS NOT NULL THEN greatest(t, u) - us END AS latency FROM q""")
def answered_by_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = topics(spark, sf_dir, "click", "purchase")
    d = timejoin.answered(a, b, "run", "us", "seq", SPAN)
    return d.select("run", "seq", (F.col("answered_at") - F.col("us")).alias("latency"))


@query(f"""WITH {S}, p AS (SELECT a.run, a.seq, a.us, b.us AS pus, b.value AS pv FROM {_A} a ASOF LEFT JOIN {_B} b ON a.run = b.run AND a.us - 21600000000 >= b.us),
n AS (SELECT p.*, b.us AS nus, b.value AS nv FROM p ASOF LEFT JOIN {_B} b ON p.run = b.run AND p.us - 21600000000 < b.us)
SELECT run, seq, round(CASE WHEN pus IS NULL OR us - 21600000000 - pus > 172800000000 THEN NULL WHEN nus IS NULL OR pus = us - 21600000000 THEN pv ELSE pv + (nv - pv) * ((us - 21600000000 - pus) / (nus - pus)) END, 6) AS past FROM n""")
def history_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = topics(spark, sf_dir, "click", "view")
    return timejoin.history(a.drop("value"), b, "run", "us", "value", 6 * HOUR, 48 * HOUR, SPAN).select("run", "seq", F.round("past_value", 6).alias("past"))


@query(f"""WITH {S}, p AS (SELECT a.run, a.seq, a.us, a.value AS x, b.value AS y FROM {_A} a ASOF LEFT JOIN {_B} b ON a.run = b.run AND a.us >= b.us),
f AS (SELECT *, CASE WHEN abs(y - x) BETWEEN 5 AND 60 THEN x + (y - x) * 0.8 END AS own, CASE WHEN abs(y - x) BETWEEN 5 AND 60 THEN y - x END AS lead_ FROM p)
SELECT run, seq, round(coalesce(own, x + 0.8 * last_value(lead_ IGNORE NULLS) OVER (PARTITION BY run ORDER BY us, seq ROWS UNBOUNDED PRECEDING)), 6) AS point, own IS NOT NULL AS by_pair FROM f""")
def fused_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = topics(spark, sf_dir, "click", "view")
    d = timejoin.asof(a, b, "run", "us", ["value"], tie="seq", bucket=SPAN)
    d = rules.fused(d, "run", ["us", "seq"], "value", "other_value", 5, 60, 0.8)
    return d.select("run", "seq", F.round("point", 6).alias("point"), "by_pair")


# ---- windows and episodes


@query(f"""WITH {S}, d AS (SELECT a.run, a.seq, a.us, a.value, b.value AS other FROM {_A} a ASOF LEFT JOIN {_B} b ON a.run = b.run AND a.us >= b.us),
g AS (SELECT *, lead(value) OVER w - lag(value) OVER w AS rise FROM d WINDOW w AS (PARTITION BY run ORDER BY us))""" + ISLANDS.format(flag="coalesce(other < 40 AND rise > 0, false)", source="g", order="us") + " SELECT run, min(us) AS start, max(us) - min(us) AS span, count(*) AS rows FROM i WHERE flag GROUP BY run, island HAVING max(us) - min(us) >= 7200000000")
def braking_while_rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = topics(spark, sf_dir, "click", "view")
    d = grid.centred_difference(timejoin.asof(a, b, "run", "us", ["value"], tie="seq", bucket=SPAN), ["run"], "us", "value")
    g = islands.true_runs(d, ["run"], [F.col("us")], (F.col("other_value") < 40) & (F.col("slope") > 0))
    return g.select("run", "start", (F.col("end") - F.col("start")).alias("span"), "rows").where(F.col("span") >= 2 * HOUR)


@query(f"""WITH {S}, d AS (SELECT a.*, b.value AS other, b.us AS other_us, least(lead(a.us) OVER (PARTITION BY a.run ORDER BY a.us) - a.us, 14400000000) AS dt FROM {_A} a ASOF LEFT JOIN {_B} b ON a.run = b.run AND a.us >= b.us)""" + ISLANDS.format(flag="coalesce(value < 30 AND other > 40 AND us - other_us <= 86400000000, false)", source="d", order="us") + " SELECT run, min(us) AS start, count(*) AS rows, coalesce(sum(dt), 0)::BIGINT AS length, round(max(other), 6) AS other_max FROM i WHERE flag GROUP BY run, island HAVING coalesce(sum(dt), 0) >= 7200000000")
def low_while_other_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = topics(spark, sf_dir, "click", "view")
    d = timejoin.asof(a, b, "run", "us", ["value"], tie="seq", bucket=SPAN)
    d = d.withColumn("dt", F.least(F.lead("us").over(Window.partitionBy("run").orderBy("us")) - F.col("us"), F.lit(4 * HOUR)))
    flag = (F.col("value") < 30) & (F.col("other_value") > 40) & (F.col("us") - F.col("other_us") <= DAY)
    g = islands.true_runs(d, ["run"], [F.col("us")], flag, F.coalesce(F.sum("dt"), F.lit(0)).alias("length"), F.round(F.max("other_value"), 6).alias("other_max"))
    return g.select("run", "start", "rows", "length", "other_max").where(F.col("length") >= 2 * HOUR)


@query(f"""WITH {S}, v AS (SELECT a.run, a.seq, a.us, CAST(floor(a.value / 40) AS BIGINT) AS level, b.value AS other FROM {_A} a ASOF LEFT JOIN {_B} b ON a.run = b.run AND a.us >= b.us),
c AS (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS b FROM v WINDOW w AS (PARTITION BY run ORDER BY us)), i AS (SELECT *, sum(b) OVER (PARTITION BY run ORDER BY us ROWS UNBOUNDED PRECEDING) AS island FROM c)
SELECT run, level, min(us) AS start, max(us) - min(us) AS span, round(max(other) - min(other), 6) AS other_range FROM i WHERE level <> 0 GROUP BY run, island, level HAVING max(us) - min(us) >= 28800000000 AND max(other) - min(other) > 20""")
def stuck_while_other_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = topics(spark, sf_dir, "click", "view")
    d = timejoin.asof(a, b, "run", "us", ["value"], tie="seq", bucket=SPAN).withColumn("level", F.floor(F.col("value") / 40))
    order = [F.col("us")]
    d = islands.numbered(d.withColumn("new", islands.changed(["run"], order, "level")), ["run"], order, F.col("new"))
    g = d.where("level <> 0").groupBy("run", "island", "level").agg(F.min("us").alias("start"), (F.max("us") - F.min("us")).alias("span"), (F.max("other_value") - F.min("other_value")).alias("r"))
    return g.where((F.col("span") >= 8 * HOUR) & (F.col("r") > 20)).select("run", "level", "start", "span", F.round("r", 6).alias("other_range"))


@query(f"""WITH {S}, p AS (SELECT a.run, a.seq, a.us, a.value AS x, b.value AS y, (a.us - lag(a.us) OVER w) / 1e6 AS hs, (lead(a.us) OVER w - a.us) / 1e6 AS hd, lag(a.value) OVER w AS f0, lead(a.value) OVER w AS f1 FROM {_A} a ASOF LEFT JOIN {_B} b ON a.run = b.run AND a.us >= b.us WINDOW w AS (PARTITION BY a.run ORDER BY a.us)),
g AS (SELECT *, 3600 * CASE WHEN hs IS NULL THEN (f1 - x) / hd WHEN hd IS NULL THEN (x - f0) / hs ELSE (hs * hs * f1 + (hd * hd - hs * hs) * x - hd * hd * f0) / (hs * hd * (hs + hd)) END AS slope FROM p)
SELECT run, count(*) AS n, round(avg(y / x), 6) AS ratio FROM g WHERE x > 10 AND abs(slope) < 10 AND abs(x - y) < 30 GROUP BY run HAVING count(*) >= 3""")
def fix_scale_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = topics(spark, sf_dir, "click", "view")
    d = grid.gradient(timejoin.asof(a, b, "run", "us", ["value"], tie="seq", bucket=SPAN), ["run"], "us", "value")
    good = d.where((F.col("value") > 10) & (F.abs(F.col("slope") * 3600) < 10) & (F.abs(F.col("value") - F.col("other_value")) < 30))
    return good.groupBy("run").agg(F.count("*").alias("n"), F.round(F.avg(F.col("other_value") / F.col("value")), 6).alias("ratio")).where("n >= 3")


# ---- figures and fits


@query(f"""WITH {S}, p AS (SELECT a.run, a.us, a.value AS ref, b.value AS est, a.value - b.value AS e FROM {_A} a ASOF LEFT JOIN {_B} b ON a.run = b.run AND a.us >= b.us)
SELECT run, count(*) AS rows, count(e) AS n, round(count(e) / count(*), 6) AS pair_share, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias, round(max(abs(e)), 6) AS worst, round(count(*) FILTER (abs(e) <= 20) / nullif(count(e), 0), 6) AS within_20,
count(*) FILTER (ref < 20 AND est >= 20) AS false_rest, round(avg(ref), 6) AS mean_ref, round(avg(est), 6) AS mean_est, round(stddev_pop(e), 6) AS spread, round((max(us) - min(us)) / 3.6e9, 6) AS hours, round(corr(ref, est), 6) AS agreement FROM p GROUP BY ROLLUP (run)""")
def run_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of each run, and of all runs together (run null); every one of them is a mergeable sum."""
    e, ref, est = F.col("e"), F.col("ref"), F.col("est")
    n = F.count("e")
    both = F.col("e").isNotNull()
    return pairs(spark, sf_dir).rollup("run").agg(
        F.count("*").alias("rows"), n.alias("n"), r6(n / F.count("*")).alias("pair_share"), r6(F.avg(F.abs(e))).alias("mae"), r6(F.sqrt(F.avg(e * e))).alias("rmse"), r6(F.avg(e)).alias("bias"), r6(F.max(F.abs(e))).alias("worst"),
        r6(F.count_if(F.abs(e) <= 20) / F.nullif(n, F.lit(0))).alias("within_20"), F.count_if((ref < 20) & (est >= 20)).alias("false_rest"), r6(F.avg(ref)).alias("mean_ref"), r6(F.avg(est)).alias("mean_est"),
        r6(F.stddev_pop(e)).alias("spread"), r6((F.max("us") - F.min("us")) / 3.6e9).alias("hours"), r6(stats.correlation(F.when(both, ref), F.when(both, est))).alias("agreement"),
    )


SCORED = ["zero", "drop", "scale_low", "scale_high", "outliers", "spike", "missing"]


@query(f"{_F}, b AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, run, seq, value FROM (" + FAULT_SQL[k] + ")" for k in SCORED) + f"""), k AS (SELECT unnest([{", ".join(repr(k) for k in SCORED)}]) AS kind),
j AS (SELECT k.kind, c.run, c.value, b.value AS bad, b.seq IS NULL AS gone FROM c CROSS JOIN k LEFT JOIN b ON b.kind = k.kind AND b.run = c.run AND b.seq = c.seq)
SELECT kind, count(*) AS rows, count(*) FILTER (gone) AS lost, count(*) FILTER (NOT gone AND bad IS NULL AND value IS NOT NULL) AS empty, round(avg(abs(bad - value)), 6) AS mae, round(sqrt(avg((bad - value) ** 2)), 6) AS rmse, round(max(abs(bad - value)), 6) AS worst FROM j GROUP BY kind""")
def fault_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of fault put into every run and scored against the clean series; one job, each kind a branch."""
    clean = clicks(spark, sf_dir)
    bad = reduce(DataFrame.unionByName, (faults.with_fault(clean, k, fault_start(), 5 * DAY, apart=DAY).select(F.lit(k).alias("kind"), "run", "seq", F.round("value", 6).alias("bad"), F.lit(True).alias("there")) for k in SCORED))
    each = clean.select("run", "seq", "value", F.explode(F.array(*map(F.lit, SCORED))).alias("kind"))
    d = each.join(bad, ["kind", "run", "seq"], "left").withColumn("e", F.col("bad") - F.col("value"))
    return d.groupBy("kind").agg(
        F.count("*").alias("rows"), F.count_if(F.col("there").isNull()).alias("lost"), F.count_if(F.col("there") & F.col("bad").isNull() & F.col("value").isNotNull()).alias("empty"),
        r6(F.avg(F.abs("e"))).alias("mae"), r6(F.sqrt(F.avg(F.col("e") ** 2))).alias("rmse"), r6(F.max(F.abs("e"))).alias("worst"),
    )


DELAYS, GAINS = [0, 2, 6, 12, 24], [0.5, 0.75, 1.0]


@query(f"""WITH {S}, q AS (SELECT run, us, value, d, us - d * 3600000000 AS at FROM {_A}, (SELECT unnest({DELAYS}) AS d)), p AS (SELECT q.*, b.value AS u FROM q ASOF LEFT JOIN {_B} b ON q.run = b.run AND q.at >= b.us),
g AS (SELECT CAST(d AS INTEGER) AS delay, CAST(g AS DOUBLE) AS gain, count(u) AS n, round(sqrt(avg((value - g * u) ** 2)), 6) AS rmse FROM p, (SELECT unnest({GAINS}) AS g) GROUP BY 1, 2) SELECT *, row_number() OVER (ORDER BY rmse, delay, gain) = 1 AS best FROM g""")
def delay_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of a delayed and scaled input for every delay and gain; the parameters are an array in each row."""
    a, b = topics(spark, sf_dir, "click", "view")
    q = a.select("run", F.col("us").alias("own"), "value", F.explode(F.array(*map(F.lit, DELAYS))).alias("delay")).withColumn("us", F.col("own") - F.col("delay").cast("long") * HOUR)
    p = timejoin.asof(q, b, "run", "us", ["value"], tie="seq", bucket=SPAN).withColumn("gain", F.explode(F.array(*map(F.lit, GAINS))))
    e = F.col("value") - F.col("gain") * F.col("other_value")
    g = p.groupBy("delay", "gain").agg(F.count("other_value").alias("n"), r6(F.sqrt(F.avg(e * e))).alias("rmse"))
    first = g.agg(F.min(F.struct("rmse", "delay", "gain")).alias("m")).select("m.*").withColumn("best", F.lit(True))
    return g.join(F.broadcast(first), ["rmse", "delay", "gain"], "left").withColumn("best", F.coalesce("best", F.lit(False)))  # one row


@query(f"""WITH {S}, d AS (SELECT run, topic, value, (lead(value) OVER w - lag(value) OVER w) / ((lead(us) OVER w - lag(us) OVER w) / 3.6e9) AS a FROM s WINDOW w AS (PARTITION BY run, topic ORDER BY us)),
t AS (SELECT topic, CAST(floor(value / 20) AS BIGINT) AS level, count(*) AS n, avg(a) AS a FROM d WHERE a IS NOT NULL AND value < 100 GROUP BY 1, 2), c AS (SELECT topic, a AS coast FROM t WHERE level = 2)
SELECT topic, level, n, round(CASE WHEN level > 2 THEN greatest(a, coast) WHEN level < 2 THEN least(a, coast) ELSE a END, 6) AS mean, CASE WHEN level > 2 THEN a < coast WHEN level < 2 THEN a > coast ELSE false END AS bound FROM t JOIN c USING (topic)""")
def sign_constrained_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = grid.centred_difference(series(spark, sf_dir), ["run", "topic"], "us", "value").withColumn("a", F.col("slope") * 3600)
    t = d.where(F.col("a").isNotNull() & (F.col("value") < 100)).groupBy("topic", F.floor(F.col("value") / 20).alias("level")).agg(F.count("*").alias("n"), F.avg("a").alias("a"))
    t = rules.bounded_by(t, ["topic"], "level", 2, "a")
    return t.select("topic", "level", "n", r6(F.col("fixed")).alias("mean"), "bound")


@query(f"""WITH {S}, w AS (SELECT run, us // 432000000000 AS w, count(*) AS n, sum(value) AS s1, sum(value * value) AS s2 FROM s GROUP BY 1, 2), f AS (SELECT *, n >= 4 AS enough, sqrt(greatest(s2 / n - (s1 / n) ** 2, 0)) <= 40 AS calm FROM w)
SELECT run, count(*) AS windows, count(*) FILTER (enough) AS enough, count(*) FILTER (enough AND calm) AS used, round(sum(s1) FILTER (enough AND calm) / sum(n) FILTER (enough AND calm), 6) AS mean, round(sqrt(greatest(sum(s2) FILTER (enough AND calm) / sum(n) FILTER (enough AND calm) - (sum(s1) FILTER (enough AND calm) / sum(n) FILTER (enough AND calm)) ** 2, 0)), 5) AS sd FROM f GROUP BY run""")
def adaptation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    w = series(spark, sf_dir).groupBy("run", F.floor(F.col("us") / (5 * DAY)).alias("w")).agg(F.count("*").alias("n"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2"))
    enough = F.col("n") >= 4
    calm = F.sqrt(F.greatest(F.col("s2") / F.col("n") - (F.col("s1") / F.col("n")) ** 2, F.lit(0.0))) <= 40
    n, s1, s2 = (F.sum(F.when(enough & calm, F.col(c))) for c in ("n", "s1", "s2"))
    return w.groupBy("run").agg(F.count("*").alias("windows"), F.count_if(enough).alias("enough"), F.count_if(enough & calm).alias("used"), r6(s1 / n).alias("mean"), F.round(F.sqrt(F.greatest(s2 / n - (s1 / n) ** 2, F.lit(0.0))), 5).alias("sd"))


# ---- space


@query(f"SELECT k, round(lat, 7) AS lat, round(lon, 7) AS lon, round((k % 900)::DOUBLE, 4) AS alt FROM ({PLACE})")
def ecef_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = places(spark, sf_dir)
    lat, lon, alt = geo.ecef_inverse(*geo.ecef(F.col("lat"), F.col("lon"), (F.col("k") % 900).cast("double")))
    return d.select("k", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"), F.round(alt, 4).alias("alt"))


ORIGIN = (50.0, 30.0, 120.0)


@query("""WITH p AS (SELECT c_custkey AS k, 50 + (c_custkey % 97 - 48) / 1000.0::DOUBLE AS lat, 30 + (c_custkey % 89 - 44) / 1000.0::DOUBLE AS lon FROM customer) SELECT k, CASE k % 3 WHEN 0 THEN 'geo' WHEN 1 THEN 'enu' ELSE 'equirect' END AS frame, round(lat, 7) AS lat, round(lon, 7) AS lon FROM p""")
def frame_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written in one of three frames each, and read back by it."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k.alias("k"), (50 + (k % 97 - 48) / 1000).alias("lat"), (30 + (k % 89 - 44) / 1000).alias("lon"))
    p = p.withColumn("frame", F.when(F.col("k") % 3 == 0, "geo").when(F.col("k") % 3 == 1, "enu").otherwise("equirect"))
    p = p.withColumn("at", geo.in_frame(F.col("frame"), F.col("lat"), F.col("lon"), F.lit(150.0), ORIGIN))
    back = geo.from_frame(F.col("frame"), F.col("at"), ORIGIN)
    return p.select("k", "frame", F.round(back["lat"], 7).alias("lat"), F.round(back["lon"], 7).alias("lon"))


@query(f"""{POINTS}, q AS (SELECT label AS probe, round(avg(x), 6) AS px, round(avg(y), 6) AS py FROM p GROUP BY label), d AS (SELECT probe, px, py, x, y, sqrt((x - px) ** 2 + (y - py) ** 2) AS d FROM q, p)
SELECT probe, count(*) AS n, round(sum(x / (1 + d)) / sum(1 / (1 + d)), 5) AS cx, round(sum(y / (1 + d)) / sum(1 / (1 + d)), 5) AS cy FROM d WHERE d <= 9 GROUP BY probe""")
def weighted_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    probes = p.groupBy(F.col("label").alias("probe")).agg(F.round(F.avg("x"), 6).alias("px"), F.round(F.avg("y"), 6).alias("py"))
    return spatial.snapped(probes, p, "probe", 9).select("probe", "n", F.round("cx", 5).alias("cx"), F.round("cy", 5).alias("cy"))


@query(TRACK + """, d AS (SELECT a.run, a.seq, a.y - b.y AS side, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, b.run AS other, b.seq AS other_seq FROM t a JOIN t b ON a.run <> b.run AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3),
m AS (SELECT *, row_number() OVER (PARTITION BY run, seq ORDER BY round(d, 9), other, other_seq) AS r FROM d WHERE d <= 3) SELECT run, count(*) AS n, round(avg(side), 5) AS side, round(quantile_cont(round(side, 6), 0.5), 5) AS middle FROM m WHERE r = 1 GROUP BY run""")
def track_cross_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spatial.offsets_to_others(tracks(spark, sf_dir), "run", "seq", "x", "y", 3.0)
    return d.groupBy("run").agg(F.count("*").alias("n"), F.round(F.avg("side"), 5).alias("side"), F.round(F.percentile(F.round("side", 6), F.lit(0.5)), 5).alias("middle"))
