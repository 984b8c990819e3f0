"""Queries of searches with headings, and of receivers with glitches."""

from __future__ import annotations

from math import radians

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import faults, snapping, spatial
from ..sources.tables import series, table
from .building import TRACK, tracks
from .events import S

QUERIES, SQL = {}, {}
DAY = 86_400_000_000
MOST = radians(35)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# The cloud is a map of cells of the embeddings' first components, with headings away from the origin: as large as the
# plane it covers, however many points made it.
CLOUD = """e AS (SELECT CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y FROM embeddings), f AS (SELECT *, atan2(x, y) AS h FROM e),
c AS (SELECT CAST(floor(x) AS BIGINT) * 2400000 + CAST(floor(y) AS BIGINT) * 24 + ((CAST(floor(degrees(h) / 15) AS BIGINT) % 24) + 24) % 24 AS id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(atan2(sum(sin(h)), sum(cos(h))), 6) AS heading, count(*)::DOUBLE AS weight FROM f GROUP BY 1),
q AS (SELECT c_custkey AS k, (c_custkey % 37 - 18) * 1.5 AS px, (c_custkey % 29 - 14) * 1.5 AS py, (c_custkey % 13) * 0.5 AS ph FROM customer),
d AS (SELECT q.*, c.*, sqrt((x - px) ** 2 + (y - py) ** 2) AS d FROM q, c)"""


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = ((F.get("embedding", F.lit(k)).cast("double") * 100) for k in (0, 1))
    e = table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"), y.alias("y"))
    c = spatial.point_cloud(e, "x", "y", F.atan2("x", "y"), "vec_id", 1, 1)
    place = F.col("cx") * 2_400_000 + F.col("cy") * 24 + F.col("hbin")
    return c.select(place.alias("id"), *(F.round(v, 6).alias(v) for v in ("x", "y", "heading")), F.col("n").cast("double").alias("weight"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    return c.select(k.alias("k"), ((k % 37 - 18) * 1.5).alias("px"), ((k % 29 - 14) * 1.5).alias("py"), (k % 13 * 0.5).alias("ph"))


@query(f"""WITH {CLOUD}, n AS (SELECT k, px, py, ph, x, y, heading, weight / (1 + d) AS w FROM d WHERE d <= 9 AND weight > 0 AND abs(atan2(sin(heading - ph), cos(heading - ph))) <= {MOST!r}),
g AS (SELECT k, count(*) AS n, atan2(sum(w * sin(heading)), sum(w * cos(heading))) AS h, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy FROM n GROUP BY k),
a AS (SELECT q.k, coalesce(n, 0) AS n, px, py, ph, h, (px - cx) * cos(h) - (py - cy) * sin(h) AS o FROM q LEFT JOIN g USING (k))
SELECT k, n, round(coalesce(px - cos(h) * o, px), 5) + 0.0 AS x, round(coalesce(py + sin(h) * o, py), 5) + 0.0 AS y, round(coalesce(h, ph), 5) + 0.0 AS heading FROM a""")
def heading_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = snapping.snap(probes(spark, sf_dir), cloud(spark, sf_dir), "k", 9.0, MOST)
    return d.select("k", "n", *((F.round(c, 5) + 0.0).alias(c) for c in ("x", "y", "heading")))


@query(f"""WITH {CLOUD}, m AS (SELECT k, min(round(d, 9)) AS dm, arg_min(heading, struct_pack(d := round(d, 9), id := id)) AS nh FROM d WHERE d <= 6 GROUP BY k), w AS (SELECT k, arg_max(heading, struct_pack(w := weight, i := -id)) AS wh FROM d JOIN m USING (k) WHERE round(d, 9) <= dm + 2 GROUP BY k)
SELECT k, round(CASE WHEN dm < 0.5 THEN nh ELSE wh END, 6) + 0.0 AS heading FROM q LEFT JOIN m USING (k) LEFT JOIN w USING (k)""")
def heading_of_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = snapping.heading_at(probes(spark, sf_dir), cloud(spark, sf_dir), "k", 0.5, 6.0, 2.0)
    return d.select("k", (F.round("heading", 6) + 0.0).alias("heading"))


@query(TRACK + """, h AS (SELECT run, seq, x, y, (seq % 5) * 0.3 AS h FROM t), d AS (SELECT a.run, a.seq, a.h, a.x - b.x AS e, a.y - b.y AS n, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, b.run AS other, b.seq AS other_seq FROM h a JOIN h b ON a.run <> b.run AND cos(b.h - a.h) > 0.875 AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3),
m AS (SELECT *, n * sin(h) - e * cos(h) AS l FROM d WHERE d < 3 QUALIFY row_number() OVER (PARTITION BY run, seq ORDER BY round(d, 9), other, other_seq) = 1)
SELECT run, count(*) AS n, round(quantile_cont(l, 0.5), 5) + 0.0 AS "left", round(quantile_cont(abs(l), 0.5), 5) + 0.0 AS beside, round(quantile_cont(e, 0.5), 5) + 0.0 AS east, round(quantile_cont(n, 0.5), 5) + 0.0 AS north FROM m GROUP BY run HAVING count(*) >= 5""")
def track_offset_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tracks(spark, sf_dir).withColumn("heading", F.col("seq") % 5 * 0.3)
    d = snapping.track_offsets(d, 3.0, least=5)
    return d.select("run", "n", *((F.round(c, 5) + 0.0).alias(c) for c in ("left", "beside", "east", "north")))


def _u(name: str) -> str:
    """The number in [0, 1) that a burst draws under a name."""
    return f"(CAST(CAST('0x' || substr(md5(concat_ws(':', run, k, '{name}')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)"


def _has(name: str) -> str:
    return f"(k >= 3 AND {_u(name)} < {faults.GLITCHES[name]})"


@query(f"""WITH {S}, r AS (SELECT run, seq, topic AS receiver, us AS tb, us // 3600000000 * 3600000000 AS th, value AS x, value / 2 AS y, 2 AS status, (us - min(us) OVER (PARTITION BY run)) // {DAY} AS k FROM s WHERE topic IN ('click', 'view')),
b AS (SELECT *, dense_rank() OVER (PARTITION BY run, k ORDER BY th) - 1 AS e, min(tb) OVER (PARTITION BY run, k) AS lo FROM r WHERE k < 3 OR {_u('sparse')} < 0.25),
c AS (SELECT *, max(e) OVER (PARTITION BY run, k) + 1 AS al, 1 + floor(5 * {_u('jump_n')}) AS jn, tb - lo AS into_, 0.8 * {_u('stamp_at')} * {DAY} AS since FROM b),
d AS (SELECT *, floor({_u('jump_at')} * greatest(1, al - jn)) AS ja FROM c),
f AS (SELECT *, CASE WHEN {_has('jump')} AND e >= ja AND e < ja + jn THEN 15 + 65 * {_u('jump_far')} ELSE 0 END AS jf, 2 * pi() * {_u('jump_turn')} AS jt, CASE WHEN {_has('degraded')} THEN 5 + 10 * {_u('off_far')} ELSE 0 END AS of_, 2 * pi() * {_u('off_turn')} AS ot FROM d),
o AS (SELECT run, seq, receiver, tb, CASE WHEN {_has('stamp')} AND into_ >= since AND into_ <= since + (0.2 + 0.2 * {_u('stamp_length')}) * {DAY} THEN th + CASE WHEN {_u('stamp_sign')} < 0.5 THEN -1 ELSE 1 END * 3600000000 ELSE th END AS th, x + jf * sin(jt) + of_ * sin(ot) AS x, y + jf * cos(jt) + of_ * cos(ot) AS y, CASE WHEN {_has('degraded')} THEN 0 ELSE status END AS status FROM f WHERE NOT ({_has('alone')} AND receiver = 'view')),
z AS (SELECT * FROM d WHERE {_has('garbage')} QUALIFY row_number() OVER (PARTITION BY run, k ORDER BY tb, seq) = 1),
g AS (SELECT run, NULL::BIGINT AS seq, receiver, tb + 1 AS tb, th, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0 AS status FROM z UNION ALL SELECT run, NULL, 'view', tb + 2, th, NULL, y, 2 FROM z UNION ALL SELECT run, NULL, receiver, tb + 3, th + 5, x, y, -1 FROM z)
SELECT run, seq, receiver, tb, th, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, status FROM (SELECT * FROM o UNION ALL SELECT * FROM g)""")
def glitchy_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = series(spark, sf_dir, "click", "view").withColumn("a", F.min("us").over(Window.partitionBy("run")))
    th = F.floor(F.col("us") / 3_600_000_000) * 3_600_000_000
    d = d.select("run", "seq", F.col("topic").alias("receiver"), F.col("us").alias("tb"), th.alias("th"), F.col("value").alias("x"), (F.col("value") / 2).alias("y"), F.lit(2).alias("status"), "a")
    d = faults.glitchy(d, F.col("a"), DAY, "view", 3_600_000_000)
    return d.select("run", "seq", "receiver", "tb", "th", *((F.round(c, 6) + 0.0).alias(c) for c in ("x", "y")), "status")
