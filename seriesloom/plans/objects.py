"""Queries for splits and overlaps, geodesy, cells, faults, fits and sequential estimators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import faults, fitting, quantiles, sets, spatial, timejoin
from ..sources.tables import micros, series, table
from ..streaming import runner
from .events import HOUR, S, pairs, topics

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- sets


@query("SELECT doc_id, canonical, size FROM (SELECT doc_id, min(doc_id) OVER w AS canonical, count(*) OVER w AS size FROM documents WINDOW w AS (PARTITION BY sha256(text))) WHERE size > 1")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.duplicates(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, doc_id % 5 = 2 AS held FROM documents), g AS (SELECT t, bool_or(NOT held) AS train, min(doc_id) FILTER (held) AS first FROM d GROUP BY t)
SELECT doc_id, CASE WHEN NOT held THEN 'train' WHEN train THEN 'leaked' WHEN doc_id > first THEN 'repeated' ELSE 'holdout' END AS part FROM d JOIN g USING (t)""")
def leak_safe_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.leak_safe_split(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query("SELECT l.doc_id, quality, CAST('0x' || substr(md5(CAST(l.doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS fold FROM labels l")
def kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.folds(table(spark, sf_dir, "labels"), "doc_id", 5).select("doc_id", "quality", "fold")


@query("""WITH o AS (SELECT o_custkey AS cust, o_orderkey AS k, epoch_us(o_orderdate) // 86400000000 AS a, epoch_us(o_orderdate) // 86400000000 + 30 AS b FROM orders)
SELECT x.cust, x.k AS a, y.k AS b, least(x.b, y.b) - greatest(x.a, y.a) AS overlap FROM o x JOIN o y ON x.cust = y.cust AND x.k < y.k AND x.a < y.b AND y.a < x.b""")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(micros(F.col("o_orderdate")) / (24 * HOUR))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("k"), day.alias("start"), (day + 30).alias("stop"))
    return sets.overlaps(o, "cust", "k", "start", "stop", 30)


@query(f"""WITH {S}, c AS (SELECT DISTINCT run, us // 86400000000 AS day, CAST(floor(value / 20) AS BIGINT) AS level FROM s), n AS (SELECT run, count(*) AS n FROM c GROUP BY run),
p AS (SELECT a.run AS a, b.run AS b, count(*) AS shared FROM c a JOIN c b ON a.day = b.day AND a.level = b.level AND a.run < b.run GROUP BY 1, 2)
SELECT a, b, shared, round(shared / least(x.n, y.n), 6) AS ratio FROM p JOIN n x ON p.a = x.run JOIN n y ON p.b = y.run WHERE shared >= least(x.n, y.n) * 0.5""")
def cell_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = series(spark, sf_dir).select("run", F.floor(F.col("us") / (24 * HOUR)).alias("day"), F.floor(F.col("value") / 20).alias("level"))
    return sets.shared_cells(d, "run", ["day", "level"], 0.5).withColumn("ratio", F.round("ratio", 6))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey + 1 + c_nationkey AS b FROM customer WHERE c_custkey + 1 + c_nationkey <= (SELECT max(c_custkey) FROM customer)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, seen) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a) SELECT node, min(seen) AS label FROM r GROUP BY node""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    to = F.col("c_custkey") + 1 + F.col("c_nationkey")
    last = c.agg(F.max("c_custkey")).first()[0]
    return sets.components(c.where(to <= last).select(F.col("c_custkey").alias("a"), to.alias("b")))


@query("""WITH f AS (SELECT p_brand, p_partkey, p_retailprice, CASE WHEN p_retailprice - lag(p_retailprice) OVER w > 3 THEN 1 ELSE 0 END AS far FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey))
SELECT p_brand, p_partkey, sum(far) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM f""")
def single_link_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.linked_in_line(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", 3, "p_partkey").select("p_brand", "p_partkey", "cluster")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in a plane from the first two components of the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    xy = [(F.get("embedding", F.lit(k)).cast("double") * 100).alias(n) for k, n in enumerate("xy")]
    return e.select("vec_id", "label", *xy)


@query("""WITH RECURSIVE p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
r AS (SELECT label, 0::BIGINT AS i, []::STRUCT(k BIGINT, x DOUBLE, y DOUBLE)[] AS o FROM (SELECT DISTINCT label FROM p)
UNION ALL SELECT r.label, p.i, CASE WHEN len(list_filter(r.o, lambda z: sqrt((z.x - p.x) ** 2 + (z.y - p.y) ** 2) <= 8)) = 0 THEN list_append(r.o, struct_pack(k := p.vec_id, x := p.x, y := p.y)) ELSE r.o END FROM r JOIN p ON p.label = r.label AND p.i = r.i + 1),
f AS (SELECT label, arg_max(o, i) AS o FROM r GROUP BY label)
SELECT p.label, p.vec_id, list_min(list_transform(list_filter(o, lambda z: sqrt((z.x - p.x) ** 2 + (z.y - p.y) ** 2) <= 8), lambda z: z.k)) AS cluster FROM p JOIN f USING (label)""")
def cluster_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.first_fit(points(spark, sf_dir), "label", "vec_id", "x", "y", 8.0)


# ---- geodesy

PLACE = "SELECT c_custkey AS k, (c_custkey * 37 % 16000) / 100.0 - 79.995 AS lat, (c_custkey * 91 % 36000) / 100.0 - 179.995 AS lon FROM customer"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    d = table(spark, sf_dir, "customer").select(k.alias("k"), (k * 37 % 16000 / 100 - 79.995).alias("lat"), (k * 91 % 36000 / 100 - 179.995).alias("lon"))
    d = d.withColumn("zone", geo.utm_zone(F.col("lat"), F.col("lon")))
    east, north = geo.utm_forward(F.col("lat"), F.col("lon"), F.col("zone"))
    return d.withColumns({"east": east, "north": north})


_T = "sinh(atanh(sin(p)) - {e} * atanh({e} * sin(p)))".format(e=repr(geo.E))
UTM = (
    f"WITH c AS ({PLACE}), z AS (SELECT *, CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lat <= 84 AND lon >= 0 AND lon < 42 THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END "
    "ELSE CAST(floor((lon + 180) / 6) AS BIGINT) % 60 + 1 END AS zone FROM c), r AS (SELECT *, radians(lat) AS p, radians(lon - (zone * 6 - 183)) AS l FROM z), "
    f"t AS (SELECT *, {_T} AS t FROM r), q AS (SELECT *, atan2(t, cos(l)) AS xi, asinh(sin(l) / sqrt(t * t + cos(l) * cos(l))) AS eta FROM t), "
    f"u AS (SELECT k, lat, lon, zone, 500000 + {geo.K0 * geo.RADIUS!r} * (eta + " + " + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(geo.ALPHA, 1)) + f") AS east, {geo.K0 * geo.RADIUS!r} * (xi + "
    + " + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(geo.ALPHA, 1)) + ") + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END AS north FROM q)"
)


@query(UTM + " SELECT k, CAST(zone AS INT) AS zone, round(east, 3) AS east, round(north, 3) AS north FROM u")
def utm_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).select("k", "zone", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"))


@query(f"WITH c AS ({PLACE}) SELECT k, round(lat, 7) AS lat, round(lon, 7) AS lon FROM c")
def utm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = places(spark, sf_dir)
    lat, lon = geo.utm_inverse(F.col("east"), F.col("north"), F.col("zone"), F.col("lat") < 0)
    return d.select("k", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


@query(UTM + """, m AS (SELECT k, lpad(CAST(zone AS VARCHAR), 2, '0') || 'CDEFGHJKLMNPQRSTUVWX'[least(CAST(floor((lat + 80) / 8) AS INT), 19) + 1] || (CASE (zone - 1) % 3 WHEN 0 THEN 'ABCDEFGH' WHEN 1 THEN 'JKLMNPQR' ELSE 'STUVWXYZ' END)[CAST(floor(east / 100000) AS INT)]
|| 'ABCDEFGHJKLMNPQRSTUV'[(CAST(floor(north / 100000) AS INT) + CASE WHEN zone % 2 = 0 THEN 5 ELSE 0 END) % 20 + 1] AS square, CAST(floor(east % 100000) AS INT) AS e, CAST(floor(north % 100000) AS INT) AS n FROM u)
SELECT k, square || lpad(CAST(e AS VARCHAR), 5, '0') || lpad(CAST(n AS VARCHAR), 5, '0') AS code, e AS east_in, n AS north_in FROM m""")
def mgrs_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = places(spark, sf_dir).withColumn("code", geo.mgrs(F.col("lat"), F.col("zone"), F.col("east"), F.col("north")))
    parts = geo.mgrs_parts(F.col("code"))
    return d.select("k", "code", parts["east"].alias("east_in"), parts["north"].alias("north_in"))


@query(f"""WITH {S}, x AS (SELECT run, seq, sum(value * 500) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS x FROM s), w AS (SELECT *, x - floor(x / 100000) * 100000 AS w FROM x)
SELECT run, seq, round(w, 3) AS wrapped, round(x - first_value(x - w) OVER (PARTITION BY run ORDER BY seq), 3) AS unwrapped FROM w""")
def wrap_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("run").orderBy("seq")
    d = series(spark, sf_dir).withColumn("x", F.sum(F.col("value") * 500).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("w", geo.wrapped(F.col("x")))
    # a step here can exceed half a wrap, so the turns are counted against its own size
    step = F.col("value") * 500
    turns = F.coalesce(F.round((step - (F.col("w") - F.lag("w").over(w))) / 100_000), F.lit(0.0))
    d = d.withColumn("turns", turns).withColumn("unwrapped", F.col("w") + 100_000 * F.sum("turns").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.select("run", "seq", F.round("w", 3).alias("wrapped"), F.round("unwrapped", 3).alias("unwrapped"))


@query(UTM + """, v AS (SELECT unnest(['plain', 'wrapped']) AS says), o AS (SELECT k, says, east, CASE WHEN says = 'wrapped' THEN east % 100000 ELSE east END AS x FROM u, v), j AS (SELECT o.*, v.says AS judge, abs(x - CASE WHEN v.says = 'wrapped' THEN east % 100000 ELSE east END) AS miss FROM o, v)
SELECT says, judge, count(*) AS n, round(avg(miss), 3) AS mean, count(*) FILTER (miss > 1000) AS far FROM j GROUP BY says, judge""")
def convention_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.array(F.lit("plain"), F.lit("wrapped"))
    d = places(spark, sf_dir).select("east", F.explode(both).alias("says")).select("*", F.explode(both).alias("judge"))
    at = lambda c: F.when(F.col(c) == "wrapped", F.col("east") % 100_000).otherwise(F.col("east"))
    miss = F.abs(at("says") - at("judge"))
    return d.groupBy("says", "judge").agg(F.count("*").alias("n"), F.round(F.avg(miss), 3).alias("mean"), F.count_if(miss > 1000).alias("far"))


@query(f"WITH c AS ({PLACE}), e AS (SELECT k, radians(lat) AS p, radians(lon) AS l, {geo.A!r} / sqrt(1 - {geo.E2!r} * sin(radians(lat)) * sin(radians(lat))) AS n FROM c) SELECT k, round((n + 100) * cos(p) * cos(l), 3) AS x, round((n + 100) * cos(p) * sin(l), 3) AS y, round((n * {1 - geo.E2!r} + 100) * sin(p), 3) AS z FROM e")
def ecef_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = geo.ecef(F.col("lat"), F.col("lon"), F.lit(100.0))
    return places(spark, sf_dir).select("k", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"))


# ---- cells

POINTS = "WITH p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y FROM embeddings)"


@query(POINTS + """, c AS (SELECT *, atan2(y, x) AS h, CAST(floor(x / 5) AS BIGINT) AS cx, CAST(floor(y / 5) AS BIGINT) AS cy, ((CAST(floor(degrees(atan2(y, x)) / 15) AS BIGINT) % 24) + 24) % 24 AS hbin FROM p)
SELECT cx, cy, hbin, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(atan2(sum(sin(h)), sum(cos(h))), 6) AS heading, count(DISTINCT label) AS sources, count(*) AS n FROM c GROUP BY cx, cy, hbin HAVING count(DISTINCT label) >= 2""")
def point_cloud_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spatial.point_cloud(points(spark, sf_dir), "x", "y", F.atan2("y", "x"), "label", 5, 2)
    return d.select("cx", "cy", "hbin", *(F.round(c, 6).alias(c) for c in ("x", "y", "heading")), "sources", "n")


@query(POINTS + ", c AS (SELECT label AS probe, round(avg(x), 6) AS px, round(avg(y), 6) AS py FROM p GROUP BY label) SELECT probe, vec_id, round(sqrt((x - px) ** 2 + (y - py) ** 2), 6) AS d FROM p, c WHERE sqrt((x - px) ** 2 + (y - py) ** 2) <= 9")
def radius_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    probes = p.groupBy(F.col("label").alias("probe")).agg(F.round(F.avg("x"), 6).alias("px"), F.round(F.avg("y"), 6).alias("py"))
    return spatial.within(probes, p, 9).select("probe", "vec_id", F.round("d", 6).alias("d"))


RING = "SELECT s_suppkey AS seg, 100 * cos(2 * pi() * s_suppkey / 100) AS ax, 100 * sin(2 * pi() * s_suppkey / 100) AS ay, 100 * cos(2 * pi() * (s_suppkey + 1) / 100) AS ex, 100 * sin(2 * pi() * (s_suppkey + 1) / 100) AS ey, s_suppkey * 200 * sin(pi() / 100) AS s0 FROM supplier"
SEEN = "SELECT c_custkey AS k, (92 + c_custkey % 17) * cos(c_custkey * 0.37) AS px, (92 + c_custkey % 17) * sin(c_custkey * 0.37) AS py FROM customer"


_PROJECT = """WITH g AS ({line}), c AS ({seen}), t AS (SELECT *, least(greatest(((px - ax) * (ex - ax) + (py - ay) * (ey - ay)) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)), 0), 1) AS t, sqrt((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)) AS l FROM c, g),
d AS (SELECT *, sqrt((px - ax - t * (ex - ax)) ** 2 + (py - ay - t * (ey - ay)) ** 2) AS d FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(d, 9), seg) AS r FROM d WHERE d <= 14)
SELECT k, seg, round(s0 + t * l, 6) AS along, round(sign((ex - ax) * (py - ay) - (ey - ay) * (px - ax)) * d, 6) AS "cross" FROM r WHERE r = 1"""


@query(_PROJECT.format(line=RING, seen=SEEN))
def polyline_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    x, y = lambda i: 100 * F.cos(2 * F.pi() * i / 100), lambda i: 100 * F.sin(2 * F.pi() * i / 100)
    ring = table(spark, sf_dir, "supplier").select(k.alias("seg"), x(k).alias("ax"), y(k).alias("ay"), x(k + 1).alias("ex"), y(k + 1).alias("ey"), (k * 200 * F.sin(F.pi() / 100)).alias("s0"))
    seen = table(spark, sf_dir, "customer").select(c.alias("k"), ((92 + c % 17) * F.cos(c * 37 / 100)).alias("px"), ((92 + c % 17) * F.sin(c * 37 / 100)).alias("py"))  # the nearest double, however large c
    d = spatial.project(seen, ring, "k", 14)
    return d.select("k", "seg", F.round("along", 6).alias("along"), F.round("cross", 6).alias("cross"))


ZIGZAG = "SELECT s_suppkey AS seg, s_suppkey * 6::DOUBLE AS ax, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 8 END::DOUBLE AS ay, s_suppkey * 6::DOUBLE + 6 AS ex, CASE WHEN s_suppkey % 2 = 1 THEN 0 ELSE 8 END::DOUBLE AS ey, s_suppkey * 10::DOUBLE AS s0 FROM supplier"


@query(_PROJECT.format(line=ZIGZAG, seen="SELECT c_custkey AS k, c_custkey * 0.4::DOUBLE + c_custkey % 7 AS px, (c_custkey % 41 - 16)::DOUBLE AS py FROM customer"))
def polyline_projection_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers along a zigzag of one segment a supplier, each 10 long, so the line grows with its table."""
    up = lambda k: F.when(k % 2 == 0, 0.0).otherwise(8.0)
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    line = table(spark, sf_dir, "supplier").select(k.alias("seg"), (k * 6.0).alias("ax"), up(k).alias("ay"), (k * 6.0 + 6).alias("ex"), up(k + 1).alias("ey"), (k * 10.0).alias("s0"))
    seen = table(spark, sf_dir, "customer").select(c.alias("k"), (c * 0.4 + c % 7).alias("px"), (c % 41 - 16.0).alias("py"))
    d = spatial.project(seen, line, "k", 14)
    return d.select("k", "seg", F.round("along", 6).alias("along"), F.round("cross", 6).alias("cross"))


@query()
def map_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = [(float(x), 0.0) for x in range(0, 3001, 50)]
    d = series(spark, sf_dir).withColumn("x", F.sum("value").over(Window.partitionBy("run").orderBy("seq"))).withColumn("y", F.col("value") % 7)
    return spatial.match_path(d, line, "run", "seq", "value", "x", "y")


# ---- faults

DAY = 24 * HOUR


def fault_start() -> Column:
    """Five days after the day of a run's first row."""
    return F.floor(F.col("first") / DAY) * DAY + 5 * DAY


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = topics(spark, sf_dir, "click")
    return c.withColumn("first", F.min("us").over(Window.partitionBy("run")))


_F = f"""WITH {S}, c AS (SELECT run, seq, us, value, min(us) OVER (PARTITION BY run) // 86400000000 * 86400000000 + 432000000000 AS t0 FROM s WHERE topic = 'click'),
f AS (SELECT *, us >= t0 AND us < t0 + 432000000000 AS hit, last_value(CASE WHEN us < t0 THEN value END IGNORE NULLS) OVER w AS held, sum(CASE WHEN us >= t0 AND us < t0 + 432000000000 THEN 1 ELSE 0 END) OVER w AS nth FROM c WINDOW w AS (PARTITION BY run ORDER BY us, seq ROWS UNBOUNDED PRECEDING))"""
_U = "CAST(CAST('0x' || substr(md5(concat_ws(':', run, seq, 'noise', '{x}')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"
FAULT_SQL = {
    "zero": "SELECT run, seq, us, CASE WHEN hit THEN 0.0 ELSE value END AS value FROM f",
    "drop": "SELECT run, seq, us, value FROM f WHERE NOT hit",
    "stuck": "SELECT run, seq, us, CASE WHEN hit THEN coalesce(held, 0.0) ELSE value END AS value FROM f",
    "scale_low": "SELECT run, seq, us, round(CASE WHEN hit THEN value * 0.7 ELSE value END, 6) AS value FROM f",
    "scale_high": "SELECT run, seq, us, round(CASE WHEN hit THEN value * 1.3 ELSE value END, 6) AS value FROM f",
    "scale_triple": "SELECT run, seq, us, round(CASE WHEN hit THEN value * 3.0 ELSE value END, 6) AS value FROM f",
    "noise": f"SELECT run, seq, us, round(CASE WHEN hit THEN value + 5 * sqrt(-2 * ln(1 - {_U.format(x='u')})) * cos(2 * pi() * ({_U.format(x='v')})) ELSE value END, 6) AS value FROM f",
    "missing": "SELECT run, seq, us, CASE WHEN hit AND nth = 1 THEN NULL ELSE value END AS value FROM f",
    "stamp_jump": "SELECT run, seq, CASE WHEN hit AND nth = 1 THEN us + 30000000 ELSE us END AS us, value FROM f",
    "zero_then_drop": "SELECT run, seq, us, CASE WHEN us >= t0 - 86400000000 AND us < t0 THEN 0.0 ELSE value END AS value FROM f WHERE NOT hit",
    "outliers": "SELECT run, seq, us, round(CASE WHEN " + " OR ".join(f"(us >= t0 + {k * DAY} AND count(*) FILTER (us >= t0 + {k * DAY}) OVER w <= {k + 1})" for k in range(3)) + " THEN value * 3 ELSE value END, 6) AS value FROM f WINDOW w AS (PARTITION BY run ORDER BY us, seq ROWS UNBOUNDED PRECEDING)",
    "spike": "SELECT run, seq, us, round(CASE WHEN hit AND nth = 1 THEN value + 1000 ELSE value END, 6) AS value FROM f",
}


def _fault_query(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return faults.with_fault(clicks(spark, sf_dir), kind, fault_start(), 5 * DAY, before=DAY, apart=DAY).withColumn("value", F.round("value", 6))

    run.__name__ = f"fault_{kind}"
    return run


for _kind in faults.KINDS:
    query(f"{_F} {FAULT_SQL[_kind]}")(_fault_query(_kind))

_SHAPE = {
    "step": "0.3", "ramp_in": "1 - 0.7 * fall", "ramp_out": "1 - 0.7 * rise", "ramp_both": "1 - 0.7 * least(fall, rise)", "lock": "0.0", "then_lock": "CASE WHEN x < 216000 THEN 0.3 ELSE 0.0 END",
    "lock_ramp": "greatest(1 - x / 216000, 0)", "pulsed": "CASE WHEN CAST(floor(x / 54000) AS BIGINT) % 2 = 0 THEN 0.3 ELSE 1.0 END",
}


@query(f"{_F}, x AS (SELECT run, seq, value, (us - t0) / 1e6 AS x, least((us - t0) / 1e6 / 108000, 1) AS fall, least((432000 - (us - t0) / 1e6) / 108000, 1) AS rise FROM c) SELECT run, seq, "
       + ", ".join(f"round(value * CASE WHEN x >= 0 AND x < 432000 THEN {e} ELSE 1.0 END, 6) AS {k}" for k, e in _SHAPE.items()) + " FROM x")
def slip_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = clicks(spark, sf_dir).withColumn("x", (F.col("us") - fault_start()) / 1e6)
    return d.select("run", "seq", *(F.round(F.col("value") * faults.slip_shape(k, F.col("x"), 432_000.0, 0.3), 6).alias(k) for k in faults.SHAPES))


_UA = "CAST(CAST('0x' || substr(md5(concat_ws(':', run, {x})), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"


@query(f"""WITH {S}, c AS (SELECT run, seq, us, min(us) OVER w AS a, max(us) OVER w AS b FROM s WHERE topic = 'click' WINDOW w AS (PARTITION BY run)), k AS (SELECT *, (us - a) // 86400000000 AS k FROM c)
SELECT run, seq, true AS "full", false AS none, us < a + 259200000000 AS "first", us >= a + 259200000000 AS nostart, us >= a + (b - a) * (0.5 * ({_UA.format(x="'midstart'")})) AS midstart,
{_UA.format(x="k, 'sparse'")} < 0.25 AS sparse, k % 4 = 0 AND {_UA.format(x="k, 'bursts'")} < 0.75 AS bursts FROM k""")
def availability_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("run")
    (c,) = topics(spark, sf_dir, "click")
    d = c.withColumn("a", F.min("us").over(w)).withColumn("b", F.max("us").over(w))
    return d.select("run", "seq", *(faults.available(k, F.col("us"), F.col("a"), F.col("b"), F.col("run"), DAY).alias(k) for k in faults.SCENARIOS))


# ---- fits


@query(f"""WITH {S}, l AS (SELECT unnest([-12, -6, 0, 6, 12]) * 3600000000 AS lag), a AS (SELECT run, us, value AS ref, lag FROM s, l WHERE topic = 'click'), b AS (SELECT run, us + lag AS us, value, lag FROM s, l WHERE topic = 'view'),
d AS (SELECT a.run, a.lag, ref - b.value AS e FROM a ASOF LEFT JOIN b ON a.run = b.run AND a.lag = b.lag AND a.us >= b.us), g AS (SELECT run, lag, round(sqrt(avg(e * e)), 6) AS rms FROM d GROUP BY run, lag HAVING count(e) >= 5),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY rms, lag) AS r FROM g) SELECT run, lag, rms FROM r WHERE r = 1""")
def lag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = topics(spark, sf_dir, "click", "view")
    return fitting.lag_search(a, b, "run", "us", "value", [h * HOUR for h in (-12, -6, 0, 6, 12)], 5)


@query("""WITH p AS (SELECT least(greatest((l_quantity - 0) / 10, 0), 5) AS pu, least(greatest((l_discount - 0) / 0.02, 0), 5) AS pv, l_tax AS y FROM lineitem), i AS (SELECT *, least(floor(pu), 4) AS iu, least(floor(pv), 4) AS iv FROM p),
c AS (SELECT y, [{'k': CAST(iu * 6 + iv AS BIGINT), 'w': (1 - (pu - iu)) * (1 - (pv - iv))}, {'k': CAST(iu * 6 + iv + 1 AS BIGINT), 'w': (1 - (pu - iu)) * (pv - iv)}, {'k': CAST((iu + 1) * 6 + iv AS BIGINT), 'w': (pu - iu) * (1 - (pv - iv))}, {'k': CAST((iu + 1) * 6 + iv + 1 AS BIGINT), 'w': (pu - iu) * (pv - iv)}] AS c FROM i),
o AS (SELECT y, c, unnest(c) AS p FROM c), b AS (SELECT p, unnest(c) AS q FROM o) SELECT i, j, round(sum(x), 4) AS ata FROM (SELECT p.k AS i, q.k AS j, p.w * q.w AS x FROM b UNION ALL SELECT p.k, -1, p.w * y FROM o) GROUP BY i, j""")
def normal_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fitting.normal_equations(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), (0, 10, 6), (0, 0.02, 6))
    return d.withColumn("ata", F.round("ata", 4))


def _robust_sql(rounds: int) -> str:
    steps = ["k0 AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y, true AS keep FROM lineitem)"]
    for k in range(rounds + 1):
        steps.append(f"f{k} AS (SELECT g, regr_slope(CASE WHEN keep THEN y END, CASE WHEN keep THEN x END) AS slope, regr_intercept(CASE WHEN keep THEN y END, CASE WHEN keep THEN x END) AS intercept, count(CASE WHEN keep THEN y END) AS n FROM k{k} GROUP BY g)")
        if k < rounds:
            steps.append(f"e{k} AS (SELECT k.*, y - slope * x - intercept AS e FROM k{k} k JOIN f{k} USING (g))")
            steps.append(f"m{k} AS (SELECT *, quantile_cont(CASE WHEN keep THEN e END, 0.5) OVER (PARTITION BY g) AS m FROM e{k})")
            steps.append(f"d{k} AS (SELECT *, quantile_cont(CASE WHEN keep THEN abs(e - m) END, 0.5) OVER (PARTITION BY g) AS d FROM m{k})")
            steps.append(f"k{k + 1} AS (SELECT g, x, y, abs(e - m) < 4 * 1.4826 * d AS keep FROM d{k})")
    return f"WITH {', '.join(steps)} SELECT g AS l_returnflag, round(slope, 4) AS slope, round(intercept, 2) AS intercept, n FROM f{rounds}"


@query(_robust_sql(3))
def robust_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fitting.robust_regression(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")
    return d.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), "n")


@query("SELECT l_returnflag, l_linestatus, round(1 / quantile_cont(l_extendedprice / l_quantity, 0.5), 9) AS scale FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def group_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.col("l_extendedprice") / F.col("l_quantity")
    keys, none = ("l_returnflag", "l_linestatus"), F.lit(None).cast("string")
    levels = F.array(F.struct(*keys), F.struct(keys[0], none.alias(keys[1])), F.struct(none.alias(keys[0]), none.alias(keys[1])))
    d = table(spark, sf_dir, "lineitem").select(F.explode(levels).alias("k"), ratio.alias("ratio")).select("k.*", "ratio")
    g = quantiles.order_statistics(d, list(keys), "ratio", [0.5])
    return g.select(*keys, F.round(1 / F.col("x"), 9).alias("scale"))


SWEEP = [(float(a), b) for a in (5, 20, 40) for b in (0.2, 0.5, 1.0)]


@query(f"""WITH {S}, p AS (SELECT a.value - b.value AS e, b.value AS est FROM (SELECT * FROM s WHERE topic = 'click') a ASOF LEFT JOIN (SELECT * FROM s WHERE topic = 'view') b ON a.run = b.run AND a.us >= b.us),
q AS (SELECT e, a, b, sqrt(a * a + (b * est) ** 2) AS sigma FROM p, (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in SWEEP)}) g(a, b) WHERE e IS NOT NULL), c AS (SELECT a, b, avg(CAST(abs(e) <= 2 * sigma AS INT)) AS cover, avg(sigma) AS width FROM q GROUP BY a, b)
SELECT a, b, round(cover, 6) AS cover, round(width, 6) AS width FROM c ORDER BY CASE WHEN cover >= 0.9 THEN 0 ELSE 1 END, CASE WHEN cover >= 0.9 THEN round(width, 9) ELSE -round(cover, 9) END, a, b LIMIT 1""")
def sigma_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitting.sharpest(pairs(spark, sf_dir).where("e is not null"), SWEEP, F.col("e"), F.col("est"), 0.9)


@query("WITH g AS (SELECT l_linenumber AS q, round(avg(l_discount), 9) AS score FROM lineitem GROUP BY l_linenumber) SELECT q, score FROM g WHERE score <= (SELECT min(score) FROM g) * 1.01 ORDER BY q, score LIMIT 1")
def grid_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("q")).agg(F.round(F.avg("l_discount"), 9).alias("score"))
    return fitting.within_percent_of_best(g, "score", "q", 1)


# ---- sequential estimators


@query()
def stream_runner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runner.in_batch(series(spark, sf_dir, "click", "view"), runner.Settings())


@query(f"""WITH RECURSIVE {S}, v AS (SELECT run, seq, value, row_number() OVER (PARTITION BY run ORDER BY seq) AS i FROM s WHERE topic = 'click'),
r AS (SELECT run, NULL::BIGINT AS seq, 0::BIGINT AS i, 0.0::DOUBLE AS speed, 10000.0::DOUBLE AS variance FROM (SELECT DISTINCT run FROM v)
UNION ALL SELECT r.run, v.seq, v.i, CASE WHEN value IS NULL THEN speed ELSE speed + (variance + 25) / (variance + 25 + 100) * (value - speed) END, CASE WHEN value IS NULL THEN variance + 25 ELSE (variance + 25) * (1 - (variance + 25) / (variance + 25 + 100)) END FROM r JOIN v ON v.run = r.run AND v.i = r.i + 1)
SELECT run, seq, round(speed, 6) AS speed, round(variance, 6) AS variance FROM r WHERE i > 0""")
def kalman_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = runner.smoothed(series(spark, sf_dir, "click").drop("topic"), runner.Settings())
    return d.select("run", "seq", F.round("speed", 6).alias("speed"), F.round("variance", 6).alias("variance"))
