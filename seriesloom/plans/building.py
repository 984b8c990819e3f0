"""Queries for map building, slips and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import mapping
from ..sources.tables import series
from ..streaming import filters
from .events import HOUR, S
from .objects import POINTS, points

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TRACK = f"WITH {S}, t AS (SELECT *, sum(value) OVER (PARTITION BY run ORDER BY us ROWS UNBOUNDED PRECEDING) / 10 AS x, (run * 7 + seq) % 40 AS y FROM s)"


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("run").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    return series(spark, sf_dir).withColumn("x", F.sum("value").over(w) / 10).withColumn("y", ((F.col("run") * 7 + F.col("seq")) % 40).cast("double"))


STOPS = """, f AS (SELECT *, value < 35 AS flag FROM t), c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR flag <> lag(flag) OVER w THEN 1 ELSE 0 END AS b FROM f WINDOW w AS (PARTITION BY run ORDER BY us)), i AS (SELECT *, sum(b) OVER (PARTITION BY run ORDER BY us ROWS UNBOUNDED PRECEDING) AS island FROM c),
p AS (SELECT run, min(us) AS start, quantile_cont(x, 0.5) AS x, quantile_cont(y, 0.5) AS y FROM i WHERE flag GROUP BY run, island HAVING max(us) - min(us) >= 28800000000)"""


@query(TRACK + STOPS + " SELECT run, start, round(x, 6) AS x, round(y, 6) AS y FROM p")
def find_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mapping.stops(tracks(spark, sf_dir), "value", 35, 8 * HOUR, "x", "y")
    return d.select("run", "start", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(TRACK + STOPS + ", q AS (SELECT run, round(x, 6) AS x, round(y, 6) AS y FROM p) SELECT CAST(floor(x / 20) AS BIGINT) AS cx, CAST(floor(y / 20) AS BIGINT) AS cy, round(avg(x), 5) AS x, round(avg(y), 5) AS y, count(DISTINCT run) AS runs FROM q GROUP BY 1, 2 HAVING count(DISTINCT run) >= 3")
def shared_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mapping.shared_stops(find_stops(spark, sf_dir), 20, 3)
    return d.select("cx", "cy", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), "runs")


@query(POINTS + """, g AS (SELECT vec_id AS id, x, y FROM p WHERE label = 0), c AS (SELECT vec_id AS key, x, y, 1.0 + label AS weight FROM p WHERE label <> 0), h AS (SELECT c.key, weight, id, sqrt((c.x - g.x) ** 2 + (c.y - g.y) ** 2) AS d FROM c JOIN g ON sqrt((c.x - g.x) ** 2 + (c.y - g.y) ** 2) <= 3),
b AS (SELECT key, weight, id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(d, 9), id) AS r FROM h) WHERE r = 1), w AS (SELECT id, sum(weight) AS weight FROM b GROUP BY id)
SELECT round(x, 6) AS x, round(y, 6) AS y, CAST(coalesce(weight, 0) AS DOUBLE) AS weight FROM g LEFT JOIN w USING (id) UNION ALL SELECT round(x, 6), round(y, 6), CAST(weight AS DOUBLE) FROM c ANTI JOIN b USING (key)""")
def hybrid_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    graph = p.where("label = 0").select(F.col("vec_id").alias("id"), "x", "y")
    cloud = p.where("label <> 0").select(F.col("vec_id").alias("key"), "x", "y", (1.0 + F.col("label")).alias("weight"))
    return mapping.hybrid(cloud, graph, 3).select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "weight")


@query(f"""WITH {S}, d AS (SELECT run, topic, us, value - lag(value) OVER (PARTITION BY run, topic ORDER BY us) AS step FROM s), j AS (SELECT *, CASE WHEN step >= 60 THEN 1 WHEN step <= -60 THEN -1 END AS side FROM d),
a AS (SELECT run, side, us, len(list_distinct(list(topic) OVER (PARTITION BY run, side ORDER BY us RANGE BETWEEN CURRENT ROW AND 43200000000 FOLLOWING))) AS sources FROM j WHERE side IS NOT NULL),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY run, side ORDER BY us) > 43200000000 THEN 1 ELSE 0 END AS b FROM a WHERE sources >= 2), n AS (SELECT *, sum(b) OVER (PARTITION BY run, side ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT run, side, min(us) AS us, max(sources) AS sources FROM n GROUP BY run, side, session""")
def joint_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.joint_jumps(series(spark, sf_dir), "run", "us", "topic", "value", 60, 12 * HOUR)


@query(TRACK + """, w AS (SELECT run, us // 432000000000 AS w, max(x) - min(x) AS path, sqrt((arg_max(x, us) - arg_min(x, us)) ** 2 + (arg_max(y, us) - arg_min(y, us)) ** 2) AS chord FROM t GROUP BY 1, 2)
SELECT run, count(*) AS n, round(quantile_cont(path / chord, 0.5), 6) AS ratio FROM w WHERE chord > 0 AND path / chord < 1.2 GROUP BY run""")
def straight_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mapping.straight_ratio(tracks(spark, sf_dir), "run", "us", "x", "x", "y", 120 * HOUR, 1.2)
    return d.withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH RECURSIVE {S}, v AS (SELECT run, seq, value, row_number() OVER (PARTITION BY run ORDER BY seq) AS i, max(value) OVER b AS before, count(value) OVER b AS n, max(value) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ahead FROM s WINDOW b AS (PARTITION BY run ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)),
c AS (SELECT run, seq, i FROM v WHERE value >= 40 AND n = 2 AND before < 40 AND ahead > 80),
r AS (SELECT run, min(i) AS i FROM c GROUP BY run UNION ALL SELECT r.run, min(c.i) FROM r JOIN c ON c.run = r.run AND c.i >= r.i + 5 GROUP BY r.run) SELECT run, seq FROM r JOIN c USING (run, i)""")
def start_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.starts(series(spark, sf_dir), "run", "seq", "value", 40, 80, 5, 2)


@query()
def sigma_point_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.sigma_filtered(series(spark, sf_dir, "click"))
