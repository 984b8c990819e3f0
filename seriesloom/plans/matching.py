"""Queries of map matching: routes over a path graph, places on it, anchored stands, projection on tracks and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import projection, routes, timejoin
from ..operators.lineage import cut
from ..sources.tables import series, table
from .events import HOUR, S

QUERIES, SQL = {}, {}
SPAN = 240 * HOUR


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# A path is a nation, its points are the nation's suppliers in order; a path's followers are two other nations, which
# as many passages reach as customers live there.  A run's way is the values of its views, a stand a click below 30.

MAP = """p AS (SELECT s_nationkey AS path, s_suppkey, sum(5.0 + s_suppkey % 7) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS UNBOUNDED PRECEDING) - first_value(5.0 + s_suppkey % 7) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS s FROM supplier),
pts AS (SELECT path, s::DOUBLE AS s, (s * cos(path * 0.25))::DOUBLE AS x, (s * sin(path * 0.25) + s_suppkey % 3)::DOUBLE AS y FROM p), len AS (SELECT path, max(s) AS length FROM pts GROUP BY path),
c AS (SELECT c_nationkey AS k, count(*) AS n, count(*) FILTER (c_acctbal < 3000) AS stood FROM customer GROUP BY c_nationkey),
lk AS (SELECT q.path, l.path AS next, n, stood, l.length FROM (SELECT n_nationkey AS path, unnest([(n_nationkey + 7) % 25, (n_nationkey * 3 + 1) % 25]) AS k FROM nation WHERE n_nationkey % 6 <> 5) q JOIN c USING (k) JOIN len l ON l.path = q.k AND l.length > 0),
od AS (SELECT run, seq, us, sum(round(value * 0.2, 3)::DECIMAL(18, 3)) OVER (PARTITION BY run ORDER BY us, seq ROWS UNBOUNDED PRECEDING)::DOUBLE AS odo FROM s WHERE topic = 'view' AND value IS NOT NULL),
st AS (SELECT a.run, a.us, b.odo FROM (SELECT * FROM s WHERE topic = 'click' AND value < 30) a ASOF JOIN od b ON a.run = b.run AND a.us >= b.us),
stl AS (SELECT run, list(odo) AS o FROM st GROUP BY run), reach AS (SELECT run, max(odo) AS reach, o FROM od LEFT JOIN stl USING (run) GROUP BY run, o),
rt AS (SELECT run, 0 AS k, path, -least(run % 5, length)::DOUBLE AS base, length FROM (SELECT *, run % 25 AS path FROM reach) JOIN len USING (path)
UNION ALL SELECT run, k + 1, next, leaves, nl FROM (SELECT r.run, r.k, r.base + r.length AS leaves, l.next, l.length AS nl, row_number() OVER (PARTITION BY r.run ORDER BY round(ln(n + 0.5) + ln(CASE WHEN len(list_filter(coalesce(o, []), lambda z: z <= r.base + r.length AND z >= r.base + r.length - 12)) > 0 THEN (stood + 0.5) / (n + 1) ELSE 1 - (stood + 0.5) / (n + 1) END), 9) DESC, l.next) AS rn
FROM rt r JOIN reach USING (run) JOIN lk l ON l.path = r.path WHERE reach > r.base + r.length) WHERE rn = 1)"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Points (path, s, x, y) and links (path, next, n, stood, window)."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    step = 5.0 + F.col("s_suppkey") % 7
    p = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("path"), "s_suppkey", (F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.first(step).over(w)).alias("s"))
    points = p.select("path", "s", (F.col("s") * F.cos(F.col("path") * 0.25)).alias("x"), (F.col("s") * F.sin(F.col("path") * 0.25) + F.col("s_suppkey") % 3).alias("y"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("next")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 3000).alias("stood"))
    k = F.col("n_nationkey")
    links = table(spark, sf_dir, "nation").where(k % 6 != 5).select(k.alias("path"), F.explode(F.array((k + 7) % 25, (k * 3 + 1) % 25)).alias("next")).join(c, "next")
    return points, links.join(routes.lengths(points).where("length > 0").select(F.col("path").alias("next")), "next").withColumn("window", F.lit(12.0))


def odometer(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("run").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    d = series(spark, sf_dir, "view").where("value is not null")
    return d.select("run", "seq", "us", F.sum(F.round(F.col("value") * 0.2, 3).cast("decimal(18,3)")).over(w).cast("double").alias("odo"))


def walked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Points, odometer rows, stands and routes."""
    points, links = graph(spark, sf_dir)
    points, odo = cut(points), cut(odometer(spark, sf_dir))
    still = series(spark, sf_dir, "click").where("value < 30").select("run", "us")
    stands = timejoin.asof(still, odo, "run", "us", ["odo"], tie="seq", bucket=SPAN).where("other_odo is not null").select("run", "us", F.col("other_odo").alias("odo"))
    starts = odo.select("run").distinct().withColumn("path", (F.col("run") % 25).cast(dict(points.dtypes)["path"])).join(routes.lengths(points), "path")
    starts = starts.select("run", "path", F.least(F.col("run") % 5, F.col("length")).cast("double").alias("s"))
    return points, odo, stands, cut(routes.routes(starts, points, links, odo, stands))


@query(f"WITH RECURSIVE {S}, {MAP} SELECT run, k::BIGINT AS k, path, round(base, 6) + 0.0 AS base, round(length, 6) AS length, path NOT IN (SELECT path FROM lk) AS ends FROM rt")
def route_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = walked(spark, sf_dir)[3]
    return d.select("run", "k", "path", (F.round("base", 6) + 0.0).alias("base"), F.round("length", 6).alias("length"), "ends")


@query(f"""WITH RECURSIVE {S}, {MAP}, a AS (SELECT run, seq, us, odo, CASE WHEN path IS NOT NULL THEN least(greatest(odo - base, 0), length) END AS s, CASE WHEN path IS NOT NULL THEN greatest(odo - base - length, 0) END AS hold, path FROM (SELECT o.*, r.path, r.base, r.length FROM od o ASOF LEFT JOIN (SELECT * FROM rt QUALIFY row_number() OVER (PARTITION BY run, base ORDER BY k DESC) = 1) r ON o.run = r.run AND o.odo >= r.base)),
b AS (SELECT a.*, q.s AS s0, q.x AS x0, q.y AS y0 FROM a ASOF LEFT JOIN (SELECT path, s, max(x) AS x, max(y) AS y FROM pts GROUP BY path, s) q ON a.path = q.path AND a.s >= q.s),
d AS (SELECT b.*, q.s AS s1, q.x AS x1, q.y AS y1 FROM b ASOF LEFT JOIN (SELECT path, s, max(x) AS x, max(y) AS y FROM pts GROUP BY path, s) q ON b.path = q.path AND b.s < q.s)
SELECT run, seq, path, round(s, 6) AS s, round(hold, 6) AS hold, 0.0 + round(CASE WHEN s1 IS NULL OR s = s0 THEN x0 ELSE x0 + (x1 - x0) * ((s - s0) / (s1 - s0)) END, 6) AS x, 0.0 + round(CASE WHEN s1 IS NULL OR s = s0 THEN y0 ELSE y0 + (y1 - y0) * ((s - s0) / (s1 - s0)) END, 6) AS y FROM d""")
def graph_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, odo, _, route = walked(spark, sf_dir)
    d = routes.advance(odo, route, points, 200.0, 100.0)
    return d.select("run", "seq", "path", *((F.round(c, 6) + 0.0).alias(c) for c in ("s", "hold", "x", "y")))


ANCHORS = routes.AnchorRules(sigma=2.0, growth=0.2, most=40.0)


@query(f"""WITH RECURSIVE {S}, {MAP}, sp AS (SELECT run, list(base + s) AS a FROM rt JOIN pts USING (path) GROUP BY run),
n AS (SELECT run, odo, row_number() OVER (PARTITION BY run ORDER BY us, odo) AS i FROM (SELECT DISTINCT run, us, odo FROM st)),
z AS (SELECT run, 0::BIGINT AS i, 0.0::DOUBLE AS shift, 0.0::DOUBLE AS since, NULL::DOUBLE AS odo, NULL::DOUBLE AS moved FROM (SELECT DISTINCT run FROM n)
UNION ALL SELECT run, i, CASE WHEN b IS NULL THEN shift ELSE shift + (b.a - here) END, CASE WHEN b IS NULL THEN since ELSE odo END, odo, CASE WHEN b IS NOT NULL THEN b.a - here END FROM (SELECT n.run, n.i, n.odo, z.shift, z.since, n.odo + z.shift AS here,
list_sort(list_transform(list_filter(coalesce(sp.a, []), lambda x: abs(x - (n.odo + z.shift)) <= 3 * sqrt(1 + (2 + 0.2 * abs(n.odo - z.since)) ** 2) AND abs(x - n.odo) <= 40), lambda x: struct_pack(d := abs(x - (n.odo + z.shift)), a := x)))[1] AS b FROM z JOIN n ON n.run = z.run AND n.i = z.i + 1 LEFT JOIN sp ON sp.run = n.run))
SELECT run, round(odo, 6) AS odo, round(moved, 6) + 0.0 AS moved, round(shift, 6) + 0.0 AS shift FROM z WHERE moved IS NOT NULL""")
def stop_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point of a path is a stop."""
    points, _, stands, route = walked(spark, sf_dir)
    stops = points.select("path", "s", F.lit(1.0).alias("sd"))
    d = routes.anchors(stands, route, stops, ANCHORS)
    return d.select("run", *((F.round(c, 6) + 0.0).alias(c) for c in ("odo", "moved", "shift")))


# ---- projection

# A reference leads along a wave by the values of a run's clicks; the estimate runs ahead and beside it.
_REF = """f AS (SELECT run, us, sum(value) OVER (PARTITION BY run ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS w, seq FROM s WHERE topic = 'click' AND value IS NOT NULL),
r AS (SELECT run, us, any_value(seq) AS seq, max(w) AS x, 30 * sin(max(w) / 40) AS y FROM f GROUP BY run, us), e AS (SELECT run, us, x + seq % 9 AS x, y + seq % 5 - 2 + CASE WHEN seq % 37 = 0 THEN 500 ELSE 0 END AS y FROM r)"""


@query(f"""WITH {S}, {_REF}, m AS (SELECT run, us, CASE WHEN count(*) OVER w = 5 THEN quantile_cont(x, 0.5) OVER w ELSE x END AS x, CASE WHEN count(*) OVER w = 5 THEN quantile_cont(y, 0.5) OVER w ELSE y END AS y FROM r WINDOW w AS (PARTITION BY run ORDER BY us ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
n AS (SELECT *, row_number() OVER x1 AS seg, lead(x) OVER x1 AS ex, lead(y) OVER x1 AS ey, lag(x) OVER x1 AS bx, lag(y) OVER x1 AS by_ FROM m WINDOW x1 AS (PARTITION BY run ORDER BY us)),
t AS (SELECT *, coalesce(sum(sqrt((x - bx) ** 2 + (y - by_) ** 2)) OVER (PARTITION BY run ORDER BY us ROWS UNBOUNDED PRECEDING), 0) AS s FROM n WHERE ex IS NOT NULL OR bx IS NOT NULL),
g AS (SELECT run, seg, us, x AS ax, y AS ay, ex, ey, s FROM t WHERE ex IS NOT NULL UNION ALL SELECT run, 0, NULL, x - 1000 * (ex - x) / sqrt((ex - x) ** 2 + (ey - y) ** 2), y - 1000 * (ey - y) / sqrt((ex - x) ** 2 + (ey - y) ** 2), x, y, -1000 FROM t WHERE bx IS NULL
  UNION ALL SELECT run, seg, us, x, y, x + 1000 * (x - bx) / sqrt((x - bx) ** 2 + (y - by_) ** 2), y + 1000 * (y - by_) / sqrt((x - bx) ** 2 + (y - by_) ** 2), s FROM t WHERE ex IS NULL),
l AS (SELECT *, sqrt((ex - ax) ** 2 + (ey - ay) ** 2) AS len FROM g),
o AS (SELECT m.run, m.us, l.s AS s_ref, (ex - ax) / len AS ox, (ey - ay) / len AS oy FROM m JOIN l ON l.run = m.run AND l.us = m.us),
q AS (SELECT e.run, e.us, l.*, s_ref, e.x AS px, e.y AS py, least(greatest(((e.x - ax) * (ex - ax) + (e.y - ay) * (ey - ay)) / len, 0), len) AS t FROM e JOIN o USING (run, us) JOIN l ON l.run = e.run WHERE (ex - ax) * ox + (ey - ay) * oy > 0 AND s + len >= s_ref - 1000 AND s <= s_ref + 1000),
d AS (SELECT *, sqrt((px - ax - t * (ex - ax) / len) ** 2 + (py - ay - t * (ey - ay) / len) ** 2) AS dist, sign((ex - ax) * (py - ay) - (ey - ay) * (px - ax)) AS side FROM q),
h AS (SELECT *, CASE WHEN lag(seg) OVER w = seg - 1 THEN lag(dist) OVER w END AS dl, CASE WHEN lead(seg) OVER w = seg + 1 THEN lead(dist) OVER w END AS dr, min(dist) OVER (PARTITION BY run, us) AS dm FROM d WINDOW w AS (PARTITION BY run, us ORDER BY seg)),
b AS (SELECT run, us, arg_min(struct_pack(a := s + t - s_ref, c := CASE WHEN side < 0 THEN -dist ELSE dist END), struct_pack(z := abs(s + t - s_ref), seg := seg)) AS b FROM h WHERE dm <= 60 AND (dl IS NULL OR dist <= dl) AND (dr IS NULL OR dist <= dr) AND dist <= dm + 5 GROUP BY run, us)
SELECT e.run, e.us, round(b.a, 5) + 0.0 AS along, round(b.c, 5) + 0.0 AS "cross", round(s_ref, 5) AS s_ref FROM e LEFT JOIN o USING (run, us) LEFT JOIN b USING (run, us)""")
def along_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("run").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    f = series(spark, sf_dir, "click").where("value is not null").withColumn("w", F.sum("value").over(w))
    ref = cut(f.groupBy("run", "us").agg(F.first("seq").alias("seq"), F.max("w").alias("x")).withColumn("y", 30 * F.sin(F.col("x") / 40)))
    est = ref.select("run", "us", (F.col("x") + F.col("seq") % 9).alias("x"), (F.col("y") + F.col("seq") % 5 - 2 + F.when(F.col("seq") % 37 == 0, 500).otherwise(0)).alias("y"))
    d = projection.along_cross(ref.select("run", "us", "x", "y"), est, least=0.0, bucket=SPAN)
    return d.select("run", "us", *((F.round(c, 5) + 0.0).alias(c) for c in ("along", "cross", "s_ref")))


_GRAPH = """p AS (SELECT s_nationkey AS path, s_suppkey AS pos, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) * CASE WHEN s_nationkey % 2 = 0 THEN 8.0 ELSE -8.0 END AS x, s_nationkey * 6.0 + s_suppkey % 3 AS y, s_suppkey % 11 + 0.0 AS z FROM supplier),
g AS (SELECT *, row_number() OVER w AS seg, lead(x) OVER w AS ex, lead(y) OVER w AS ey, lead(z) OVER w AS ez FROM p WINDOW w AS (PARTITION BY path ORDER BY pos)),
l AS (SELECT *, sqrt((ex - x) ** 2 + (ey - y) ** 2) AS len, seg = 1 AS fst, seg = max(seg) OVER (PARTITION BY path) AS lst, coalesce(sum(sqrt((ex - x) ** 2 + (ey - y) ** 2)) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM g WHERE ex IS NOT NULL),
c AS (SELECT c_custkey AS k, (c_custkey % 97) * 1.7 - 60 AS px, (c_custkey % 61) * 2.9 - 10 AS py, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 7) * 0.9 END AS yaw FROM customer)"""


@query(f"""WITH {_GRAPH}, q AS (SELECT c.*, l.*, ((px - x) * (ex - x) + (py - y) * (ey - y)) / len AS raw FROM c, l), t AS (SELECT *, least(greatest(raw, 0), len) AS t FROM q),
d AS (SELECT *, sqrt((px - x - t * (ex - x) / len) ** 2 + (py - y - t * (ey - y) / len) ** 2) AS dist, ((ex - x) * (py - y) - (ey - y) * (px - x)) / len AS lat FROM t),
o AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY k, path ORDER BY round(dist, 9), seg) = 1), b AS (SELECT * FROM o WHERE yaw IS NULL OR cos(atan2(ey - y, ex - x) - yaw) > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(dist, 9), path) = 1)
SELECT c.k, path, round(s + t, 5) AS s, round(lat, 5) AS lat, round(dist, 5) AS dist, round(z + (ez - z) * t / len, 5) AS z, (fst AND raw < -0.5) OR (lst AND raw > len + 0.5) AS beyond FROM c LEFT JOIN b USING (k)""")
def path_graph_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    i = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    points = table(spark, sf_dir, "supplier").select(n.alias("path"), k.alias("pos"), (i * F.when(n % 2 == 0, 8.0).otherwise(-8.0)).alias("x"), (n * 6.0 + k % 3).alias("y"), (k % 11 + 0.0).alias("z"))
    c = F.col("c_custkey")
    probes = table(spark, sf_dir, "customer").select(c.alias("k"), (c % 97 * 1.7 - 60).alias("px"), (c % 61 * 2.9 - 10).alias("py"), F.when(c % 5 != 0, c % 7 * 0.9).alias("yaw"))
    d = projection.match_graph(probes, points, 12.0)
    return d.select("k", "path", *(F.round(x, 5).alias(x) for x in ("s", "lat", "dist", "z")), "beyond")
