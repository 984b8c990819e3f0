"""Queries of the audit and evaluation layer: rules, comparisons, roll-ups, detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import faults, grid, islands, rules, stats, timejoin
from ..sources.tables import series, table
from .events import GLITCHED, HOUR, S, glitched, pairs, topics
from .objects import DAY, PLACE, clicks, fault_start, places

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS none FROM events")
def number_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", rules.number(F.get_json_object("props", "$.k")).alias("k"), rules.number(F.col("event_type")).alias("none"))


@query(f"WITH {S} SELECT run, count(*) AS rows, count(CASE WHEN abs(value) <= 120 THEN 1 END) AS valid, max(us) AS clock, round(sum(least(greatest(value, 5), 60)), 4) AS clamped FROM s GROUP BY run")
def value_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return series(spark, sf_dir).groupBy("run").agg(F.count("*").alias("rows"), F.count(rules.guarded(v, 120)).alias("valid"), F.max("us").alias("clock"), F.round(F.sum(rules.clamped(v, 5, 60)), 4).alias("clamped"))


@query(f"WITH c AS ({PLACE}), f AS (SELECT k, CASE WHEN k % 11 = 0 THEN 0 WHEN k % 13 = 0 THEN 95 ELSE lat END AS lat, CASE WHEN k % 11 = 0 THEN 0 ELSE lon END AS lon, k % 4 - 1 AS status FROM c) SELECT k, lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0) AND status >= 0 AS valid FROM f")
def fix_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    lat = F.when(k % 11 == 0, 0).when(k % 13 == 0, 95).otherwise(F.col("lat"))
    lon = F.when(k % 11 == 0, 0).otherwise(F.col("lon"))
    return places(spark, sf_dir).select("k", rules.valid_fix(k, lat, lon, k % 4 - 1).alias("valid"))


@query(f"""WITH {S}, a AS (SELECT *, min(us) OVER (PARTITION BY run) AS t0 FROM s), c AS (SELECT run, min(us) AS cut FROM a WHERE us >= t0 + 259200000000 AND value > 60 GROUP BY run)
SELECT run, count(*) FILTER (us <= t0 + 864000000000) AS first_days, count(*) FILTER (us >= cut) AS after_cut, min(cut) AS cut FROM a LEFT JOIN c USING (run) GROUP BY run""")
def time_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = series(spark, sf_dir).withColumn("t0", F.min("us").over(Window.partitionBy("run")))
    cut = F.min(F.when((F.col("us") >= F.col("t0") + 3 * DAY) & (F.col("value") > 60), F.col("us"))).over(Window.partitionBy("run"))
    d = d.withColumn("cut", cut)
    return d.groupBy("run").agg(F.count_if(F.col("us") <= F.col("t0") + 10 * DAY).alias("first_days"), F.count_if(F.col("us") >= F.col("cut")).alias("after_cut"), F.min("cut").alias("cut"))


@query(f"""WITH {S}, d AS (SELECT run, topic, seq, value - 50 AS u, (lead(value) OVER w - lag(value) OVER w) / ((lead(us) OVER w - lag(us) OVER w) / 3.6e9) AS a FROM s WINDOW w AS (PARTITION BY run, topic ORDER BY us))
SELECT topic, count(*) AS kept, round(avg(a), 6) AS mean FROM d WHERE a IS NOT NULL AND NOT (abs(a) > 0.3 AND abs(u) >= 1 AND sign(a) <> sign(u)) GROUP BY topic""")
def contradiction_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = grid.centred_difference(series(spark, sf_dir), ["run", "topic"], "us", "value").withColumn("a", F.col("slope") * 3600).withColumn("u", F.col("value") - 50)
    bad = (F.abs("a") > 0.3) & (F.abs("u") >= 1) & (F.signum("a") != F.signum("u"))
    return d.where(F.col("a").isNotNull() & ~bad).groupBy("topic").agg(F.count("*").alias("kept"), F.round(F.avg("a"), 6).alias("mean"))


_IN = "(SELECT r.seq, CASE WHEN p.us IS NULL THEN n.value WHEN n.us IS NULL OR p.us = r.us THEN p.value ELSE p.value + (n.value - p.value) * ((r.us - p.us) / (n.us - p.us)) END AS v FROM r ASOF LEFT JOIN {t} p ON r.run = p.run AND r.us >= p.us ASOF LEFT JOIN {t} n ON r.run = n.run AND r.us < n.us)"


@query(f"WITH {S}, r AS (SELECT * FROM s WHERE topic = 'purchase'), a AS (SELECT * FROM s WHERE topic = 'click'), b AS (SELECT * FROM s WHERE topic = 'view') SELECT r.run, r.seq, coalesce(abs(x.v - y.v) < 40 AND abs(r.value - x.v) > 30 AND abs(r.value - y.v) > 30, false) AS glitch FROM r JOIN {_IN.format(t='a')} x USING (seq) JOIN {_IN.format(t='b')} y USING (seq)")
def glitch_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, a, b = topics(spark, sf_dir, "purchase", "click", "view")
    d = timejoin.interpolate(r, a, "run", "us", "value").withColumnRenamed("interp_value", "x")
    d = timejoin.interpolate(d, b, "run", "us", "value").withColumnRenamed("interp_value", "y")
    far = (F.abs(F.col("x") - F.col("y")) < 40) & (F.abs(F.col("value") - F.col("x")) > 30) & (F.abs(F.col("value") - F.col("y")) > 30)
    return d.select("run", "seq", F.coalesce(far, F.lit(False)).alias("glitch"))


@query("SELECT event_type, CASE WHEN event_type IN ('click', 'view') THEN 'seen' WHEN event_type IN ('purchase', 'signup') THEN 'won' ELSE 'lost' END AS code, count(*) AS n FROM events GROUP BY ALL")
def enum_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = {"seen": ["click", "view"], "won": ["purchase", "signup"], "lost": ["error"]}
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", rules.code_of(F.col("event_type"), codes).alias("code"), "n")


_G, _V = [5.0, 15.0, 30.0, 45.0], [1.0, 4.0, 2.0, 8.0]
_W = [round(0.1 * i * i + 0.3 * j, 3) for i in range(6) for j in range(6)]


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, least(greatest(l_quantity / 10, 0), 5) AS u, least(greatest(l_discount / 0.02, 0), 5) AS v FROM lineitem), i AS (SELECT *, CAST(least(floor(u), 4) AS INT) AS i, CAST(least(floor(v), 4) AS INT) AS j, {_W} AS w FROM p),
t AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN q <= 5 THEN 1.0 WHEN q <= 15 THEN 1 + 3 * ((q - 5) / 10) WHEN q <= 30 THEN 4 - 2 * ((q - 15) / 15) WHEN q <= 45 THEN 2 + 6 * ((q - 30) / 15) ELSE 8.0 END AS one,
w[i * 6 + j + 1] * (1 - (u - i)) * (1 - (v - j)) + w[i * 6 + j + 7] * (u - i) * (1 - (v - j)) + w[i * 6 + j + 2] * (1 - (u - i)) * (v - j) + w[i * 6 + j + 8] * (u - i) * (v - j) AS two FROM i)
SELECT l_orderkey, l_linenumber, l_partkey, round(CAST(one AS DOUBLE), 6) AS one, round(CAST(two AS DOUBLE), 6) AS two FROM t""")
def lookup_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = rules.table_1d(F.col("l_quantity"), _G, _V)
    two = rules.table_2d(F.col("l_quantity"), F.col("l_discount"), 6, 6, 10, 0.02, _W)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(one, 6).alias("one"), F.round(two, 6).alias("two"))


@query(f"WITH {S}, d AS (SELECT run, seq, value / 100 - 0.5 AS u, value / 10 AS v FROM s), f AS (SELECT run, seq, v, CASE WHEN u >= 0 THEN u * least(20000, 60000 / greatest(abs(v), 0.1)) ELSE u * 20000 END AS f, sign(v) * (800 + 12 * abs(v) + 1.5 * v * v) AS r FROM d) SELECT run, seq, round(least(greatest(f, -9000), 9000) - r, 8) AS force FROM f")
def drive_physics(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = F.col("value") / 100 - 0.5, F.col("value") / 10
    force = rules.adhesion_clip(rules.drive_force(u, v, 20_000, 60_000), 0.15, 60_000) - rules.resistance(v, 800, 12, 1.5)
    return series(spark, sf_dir).select("run", "seq", F.round(force, 8).alias("force"))


@query(f"""WITH {S}, d AS (SELECT run, us // 86400000000 AS day, sha256(string_agg(topic || ':' || CAST(us AS VARCHAR) || ':' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), '|' ORDER BY seq)) AS h, count(*) AS n FROM s GROUP BY 1, 2),
h AS (SELECT run, sha256(string_agg(h, '|' ORDER BY day)) AS hash, sum(n)::BIGINT AS n FROM d GROUP BY run) SELECT run, hash, n, min(run) OVER (PARTITION BY hash) AS canonical FROM h""")
def run_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of a run is that of its days' hashes, so a long run is gathered a day at a time."""
    part = F.concat_ws(":", "topic", F.col("us").cast("string"), F.round(F.col("value") * 100).cast("long").cast("string"))
    joined = lambda order, x: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, x.alias("p")))), lambda r: r["p"]), "|"), 256)
    days = series(spark, sf_dir).groupBy("run", F.floor(F.col("us") / DAY).alias("day")).agg(joined("seq", part).alias("h"), F.count("*").alias("n"))
    g = days.groupBy("run").agg(joined("day", F.col("h")).alias("hash"), F.sum("n").alias("n"))
    return g.withColumn("canonical", F.min("run").over(Window.partitionBy("hash")))


@query(f"""WITH {S}, r AS (SELECT run, CAST(count(*) AS DOUBLE) AS n, avg(value) AS mean, max(value) AS top FROM s GROUP BY run), u AS (SELECT run, unnest(['n', 'mean', 'top']) AS metric, unnest([n, mean, top]) AS v FROM r), x AS (SELECT 'all' AS subset, * FROM u UNION ALL SELECT 'even', * FROM u WHERE run % 2 = 0)
SELECT metric, subset, round(min(v), 6) AS least, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.5), 6) AS middle, round(quantile_cont(v, 0.95), 6) AS p95, round(max(v), 6) AS most, round(sum(v), 4) AS total FROM x GROUP BY metric, subset""")
def stat_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = series(spark, sf_dir).groupBy("run").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top"))
    subsets = F.explode(F.when(F.col("run") % 2 == 0, F.array(F.lit("all"), F.lit("even"))).otherwise(F.array(F.lit("all")))).alias("subset")
    x = r.unpivot("run", ["n", "mean", "top"], "metric", "v").select("metric", "v", subsets)
    p = lambda q: F.round(F.percentile("v", F.lit(q)), 6)
    return x.groupBy("metric", "subset").agg(F.round(F.min("v"), 6).alias("least"), p(0.05).alias("p05"), p(0.5).alias("middle"), p(0.95).alias("p95"), F.round(F.max("v"), 6).alias("most"), F.round(F.sum("v"), 4).alias("total"))


@query(f"""WITH {S}, c AS (SELECT run, seq, us, value, min(us) OVER (PARTITION BY run) // 86400000000 * 86400000000 + 432000000000 AS t0 FROM s WHERE topic = 'click'),
e AS (SELECT run, CASE WHEN us < t0 THEN 'before' WHEN us < t0 + 432000000000 THEN 'during' ELSE 'after' END AS part, CASE WHEN us >= t0 AND us < t0 + 432000000000 THEN value * 1.3 ELSE value END - value AS e FROM c)
SELECT part, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(max(abs(e)), 6) AS worst FROM e GROUP BY part""")
def windowed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = clicks(spark, sf_dir)
    bad = faults.with_fault(clean, "scale_high", fault_start(), 5 * DAY).select("run", "seq", F.col("value").alias("bad"))
    t0 = fault_start()
    part = F.when(F.col("us") < t0, "before").when(F.col("us") < t0 + 5 * DAY, "during").otherwise("after")
    d = clean.join(bad, ["run", "seq"]).select(part.alias("part"), (F.col("bad") - F.col("value")).alias("e"))
    return d.groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("e")), 6).alias("mae"), F.round(F.max(F.abs("e")), 6).alias("worst"))


@query(f"""WITH {S}, c AS (SELECT run, seq, value, us, min(us) OVER (PARTITION BY run) // 86400000000 * 86400000000 + 432000000000 AS t0, row_number() OVER (PARTITION BY run ORDER BY us, seq) AS pos, sum(CASE WHEN us >= a0 AND us < a0 + 432000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS nth FROM (SELECT *, min(us) OVER (PARTITION BY run) // 86400000000 * 86400000000 + 432000000000 AS a0 FROM s WHERE topic = 'click') WHERE topic = 'click'),
e AS (SELECT run, pos, value IS NOT DISTINCT FROM CASE WHEN us >= t0 AND us < t0 + 432000000000 AND nth = 1 THEN NULL ELSE value END AS same FROM c) SELECT run, count(*) AS rows, count(*) FILTER (same) AS equal, min(pos) FILTER (NOT same) AS first_difference FROM e GROUP BY run""")
def log_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = clicks(spark, sf_dir)
    w = Window.partitionBy("run").orderBy("us", "seq")
    bad = faults.with_fault(clean, "missing", fault_start(), 5 * DAY)
    a, b = (d.withColumn("pos", F.row_number().over(w)).select("run", "pos", F.col("value").alias(n)) for d, n in ((clean, "a"), (bad, "b")))
    d = a.join(b, ["run", "pos"]).withColumn("same", F.col("a").eqNullSafe(F.col("b")))
    return d.groupBy("run").agg(F.count("*").alias("rows"), F.count_if("same").alias("equal"), F.min(F.when(~F.col("same"), F.col("pos"))).alias("first_difference"))


_LOCF = "(SELECT n.run, n.node, e.value AS v FROM n ASOF LEFT JOIN (SELECT * FROM s WHERE topic = '{t}') e ON n.run = e.run AND n.us >= e.us)"


@query(f"WITH {S}, g AS (SELECT run, unnest(range(min(us) // 21600000000, max(us) // 21600000000 + 1)) AS node FROM s WHERE topic IN ('click', 'view') GROUP BY run), n AS (SELECT run, node, node * 21600000000 AS us FROM g) SELECT a.run, count(*) AS nodes, bool_and(a.v IS NOT NULL AND b.v IS NOT NULL) AS complete, round(max(abs(a.v - b.v)), 6) AS worst FROM {_LOCF.format(t='click')} a JOIN {_LOCF.format(t='view')} b USING (run, node) GROUP BY a.run")
def paired_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = series(spark, sf_dir, "click", "view")
    at = grid.nodes(both, "run", "us", 6 * HOUR)
    for name, topic in (("a", "click"), ("b", "view")):
        at = timejoin.asof(at, both.where(F.col("topic") == topic).drop("topic"), "run", "us", ["value"], tie="seq").withColumnRenamed("other_value", name).drop("other_us")
    return at.groupBy("run").agg(F.count("*").alias("nodes"), F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("complete"), F.round(F.max(F.abs(F.col("a") - F.col("b"))), 6).alias("worst"))


@query(f"""WITH {S}, f AS (SELECT *, value BETWEEN 30 AND 90 AS inside FROM s), c AS (SELECT *, coalesce(lag(inside) OVER w, true) AS was, CASE WHEN row_number() OVER w = 1 OR inside <> lag(inside) OVER w THEN 1 ELSE 0 END AS b FROM f WINDOW w AS (PARTITION BY run ORDER BY us)),
i AS (SELECT *, sum(b) OVER (PARTITION BY run ORDER BY us ROWS UNBOUNDED PRECEDING) AS island FROM c) SELECT run, min(us) AS start, max(us) AS "end", count(*) AS rows FROM i WHERE inside GROUP BY run, island HAVING NOT arg_min(was, us)""")
def zone_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.col("value").between(30, 90)
    d = series(spark, sf_dir).withColumn("was", F.coalesce(F.lag(inside).over(Window.partitionBy("run").orderBy("us")), F.lit(True)))
    return islands.true_runs(d, ["run"], [F.col("us")], inside, F.min_by("was", "us").alias("was")).where("not was").drop("island", "was")


@query(f"""WITH {S}, v AS (SELECT *, CAST(floor(value / 30) AS BIGINT) AS level FROM s), c AS (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER w THEN 1 ELSE 0 END AS b FROM v WINDOW w AS (PARTITION BY run ORDER BY seq)),
i AS (SELECT *, sum(b) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM c), n AS (SELECT run, island, count(*) AS n FROM i GROUP BY run, island) SELECT run, max(n) AS longest, count(*) FILTER (n >= 4) AS frozen FROM n GROUP BY run""")
def frozen_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = series(spark, sf_dir).withColumn("level", F.floor(F.col("value") / 30))
    d = islands.numbered(d.withColumn("new", islands.changed(["run"], [F.col("seq")], "level")), ["run"], [F.col("seq")], F.col("new"))
    n = d.groupBy("run", "island").agg(F.count("*").alias("n"))
    return n.groupBy("run").agg(F.max("n").alias("longest"), F.count_if(F.col("n") >= 4).alias("frozen"))


@query(f"""WITH {S}{GLITCHED}, p AS (SELECT *, max(th) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM g) SELECT run, seq, th FROM p WHERE last IS NULL OR th > last""")
def monotone_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.published(glitched(spark, sf_dir), ["run"], "seq", "th").select("run", "seq", "th")


@query(f"""WITH {S}{GLITCHED}, t AS (SELECT *, CASE WHEN tb >= min(tb) OVER (PARTITION BY run) + 864000000000 THEN 1 ELSE 0 END AS late FROM g) SELECT run, seq, row_number() OVER (PARTITION BY run ORDER BY late, CASE WHEN late = 0 THEN th ELSE tb END, tb) AS place FROM t""")
def start_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.start_sorted(glitched(spark, sf_dir), "run", "tb", "th", 10 * DAY).select("run", "seq", "place")


@query(f"WITH {S} SELECT run, seq, count(value) OVER w = 3 AND max(value) OVER w - min(value) OVER w <= 25 AND us - min(us) OVER w >= 21600000000 AS agreed FROM s WINDOW w AS (PARTITION BY run ORDER BY us ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def confirmation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.confirmed(series(spark, sf_dir), ["run"], "us", "value", 3, 25, 6 * HOUR).select("run", "seq", "agreed")


@query(f"WITH {S}, n AS (SELECT *, row_number() OVER w - 1 AS n, count(*) OVER (PARTITION BY run) AS al, max(abs(value)) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS peak FROM s WINDOW w AS (PARTITION BY run ORDER BY seq)) SELECT run, seq, round(peak, 6) AS peak FROM n WHERE n % 5 = 0 OR n = al - 1")
def track_decimation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.decimated(series(spark, sf_dir), ["run"], "seq", 5, "value").select("run", "seq", F.round("peak", 6).alias("peak"))


@query(f"""WITH {S}, l AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY seq) * 10.0 AS x, value AS y, seq FROM s), d AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS d FROM l WINDOW w AS (PARTITION BY run ORDER BY seq)),
a AS (SELECT *, sum(d) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS b FROM d), g AS (SELECT run, lag(b) OVER w AS a, b, lag(x) OVER w AS xa, lag(y) OVER w AS ya, x AS xb, y AS yb FROM a WINDOW w AS (PARTITION BY run ORDER BY seq)),
n AS (SELECT *, unnest(range(CAST(floor(a / 100) AS BIGINT) + CASE WHEN a = 0 THEN 0 ELSE 1 END, CAST(floor(b / 100) AS BIGINT) + 1)) AS node FROM g WHERE b > a) SELECT run, node, round(xa + (xb - xa) * ((node * 100 - a) / (b - a)), 5) AS x, round(ya + (yb - ya) * ((node * 100 - a) / (b - a)), 5) AS y FROM n""")
def polyline_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = series(spark, sf_dir).withColumn("x", F.row_number().over(Window.partitionBy("run").orderBy("seq")) * 10.0).withColumnRenamed("value", "y")
    d = rules.densified(d, "run", "seq", "x", "y", 100)
    return d.select("run", "node", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query(f"""WITH {S}, c AS (SELECT * FROM s WHERE topic = 'click'), h AS (SELECT unnest([6, 12, 24]) AS hours), q AS (SELECT run, seq, value, hours, us + hours * 3600000000 AS us FROM c, h)
SELECT hours, count(c.value) AS n, round(sqrt(avg((c.value - q.value) ** 2)), 6) AS rmse FROM q ASOF LEFT JOIN c ON q.run = c.run AND q.us <= c.us GROUP BY hours""")
def open_loop_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = topics(spark, sf_dir, "click")
    q = c.select("run", F.col("value").alias("said"), F.explode(F.array(*map(F.lit, (6, 12, 24)))).alias("hours"), "us").withColumn("us", F.col("us") + F.col("hours") * HOUR)
    e = F.col("other_value") - F.col("said")
    return timejoin.asof_forward(q, c, "run", "us", ["value"]).groupBy("hours").agg(F.count("other_value").alias("n"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"))


@query("""WITH d AS (SELECT l_returnflag AS g, l_extendedprice / 1000 AS y, CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS fold FROM lineitem), f AS (SELECT g, fold, sum(y) AS s, count(*) AS n FROM d GROUP BY g, fold), o AS (SELECT g, fold, (sum(s) OVER (PARTITION BY g) - s) / (sum(n) OVER (PARTITION BY g) - n) AS own FROM f),
h AS (SELECT fold, sum(s) AS s, sum(n) AS n FROM f GROUP BY fold), p AS (SELECT fold, ((SELECT sum(s) FROM h) - s) / ((SELECT sum(n) FROM h) - n) AS shared FROM h) SELECT d.g, count(*) AS n, round(sqrt(avg((y - own) ** 2)), 6) AS own, round(sqrt(avg((y - shared) ** 2)), 6) AS shared FROM d JOIN o ON d.g = o.g AND d.fold = o.fold JOIN p ON d.fold = p.fold GROUP BY d.g""")
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.conv(F.substring(F.md5(F.col("l_orderkey").cast("string")), 1, 8), 16, 10).cast("long") % 5
    d = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_extendedprice") / 1000).alias("y"), fold.alias("fold"))
    f = d.groupBy("g", "fold").agg(F.sum("y").alias("s"), F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("q"))
    g, one = Window.partitionBy("g"), Window.partitionBy("fold")
    all_ = Window.partitionBy(F.lit(1))  # a row for each group and fold
    f = f.withColumn("own", (F.sum("s").over(g) - F.col("s")) / (F.sum("n").over(g) - F.col("n")))
    f = f.withColumns({"fs": F.sum("s").over(one), "fn": F.sum("n").over(one), "ts": F.sum("s").over(all_), "tn": F.sum("n").over(all_)})
    f = f.withColumn("shared", (F.col("ts") - F.col("fs")) / (F.col("tn") - F.col("fn")))
    square = lambda m: F.sqrt(F.sum(F.col("q") - 2 * F.col(m) * F.col("s") + F.col("n") * F.col(m) * F.col(m)) / F.sum("n"))
    return f.groupBy("g").agg(F.sum("n").alias("n"), F.round(square("own"), 6).alias("own"), F.round(square("shared"), 6).alias("shared"))


@query("""WITH g AS (SELECT l_suppkey, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxx(l_extendedprice, l_quantity) AS sxx FROM lineitem GROUP BY l_suppkey), r AS (SELECT *, sqrt(greatest(syy - b * b * sxx, 0) / (n - 2) / sxx) AS sd FROM g WHERE n >= 20)
SELECT l_suppkey, n, round(b, 4) AS slope, round(sd / abs(b), 4) AS relative, sd / abs(b) < 0.5 AS sufficient FROM r""")
def batch_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("b"), F.regr_syy(y, x).alias("syy"), F.regr_sxx(y, x).alias("sxx")).where("n >= 20")
    sd = F.sqrt(F.greatest(F.col("syy") - F.col("b") * F.col("b") * F.col("sxx"), F.lit(0.0)) / (F.col("n") - 2) / F.col("sxx"))
    return g.select("l_suppkey", "n", F.round("b", 4).alias("slope"), F.round(sd / F.abs("b"), 4).alias("relative"), (sd / F.abs("b") < 0.5).alias("sufficient"))


@query(f"WITH {S}, e AS (SELECT run, arg_min(value, seq) AS a, arg_max(value, seq) AS b, max(value) AS hi, min(value) AS lo FROM s GROUP BY run) SELECT run, CASE WHEN b - a > 10 THEN 'up' WHEN b - a < -10 THEN 'down' WHEN hi - a > a - lo THEN 'up' ELSE 'down' END AS direction FROM e")
def direction_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = series(spark, sf_dir).groupBy("run").agg(F.min_by("value", "seq").alias("a"), F.max_by("value", "seq").alias("b"), F.max("value").alias("hi"), F.min("value").alias("lo"))
    net = F.col("b") - F.col("a")
    return g.select("run", F.when(net > 10, "up").when(net < -10, "down").when(F.col("hi") - F.col("a") > F.col("a") - F.col("lo"), "up").otherwise("down").alias("direction"))


@query(f"""WITH {S}, p AS (SELECT a.run, a.value - b.value AS e FROM (SELECT * FROM s WHERE topic = 'click') a ASOF LEFT JOIN (SELECT * FROM s WHERE topic = 'view') b ON a.run = b.run AND a.us >= b.us), m AS (SELECT run, avg(abs(e)) AS mae, count(e) AS n FROM p GROUP BY run)
SELECT CASE WHEN mae <= 40 THEN 'met' WHEN mae <= 50 THEN 'near' ELSE 'missed' END AS compliance, count(*) AS runs, round(sum(mae * n) / sum(n), 6) AS mae FROM m GROUP BY 1""")
def compliance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = pairs(spark, sf_dir).groupBy("run").agg(F.avg(F.abs("e")).alias("mae"), F.count("e").alias("n"))
    level = F.when(F.col("mae") <= 40, "met").when(F.col("mae") <= 50, "near").otherwise("missed")
    return m.groupBy(level.alias("compliance")).agg(F.count("*").alias("runs"), F.round(stats.weighted_mean(F.col("mae"), F.col("n")), 6).alias("mae"))
