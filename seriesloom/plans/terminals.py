"""Queries of the ends of lines: planar clusters, terminals, passages, branches behind dead ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import clusters, terminals
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


def linked(p: str, link: float, n: str = "") -> str:
    """lab{n} (g, k, cluster) of points p (k, g, x, y): the smallest key that steps within a link reach."""
    return f"""e{n} AS MATERIALIZED (SELECT a.g, a.k AS a, b.k AS b FROM {p} a JOIN {p} b ON a.g = b.g AND sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) <= {link}),
l{n}(g, k, cluster) AS (SELECT g, k, k FROM {p} UNION SELECT l{n}.g, e{n}.b, l{n}.cluster FROM l{n} JOIN e{n} ON l{n}.g = e{n}.g AND l{n}.k = e{n}.a), lab{n} AS MATERIALIZED (SELECT g, k, min(cluster) AS cluster FROM l{n} GROUP BY g, k)"""


# A run's way is a fifth of its values; it leads along the x axis up to 0, and on along one of four branches.
TRACK = f"""{S}, v AS (SELECT run, seq, us, sum(round(value * 0.2, 3)::DECIMAL(18, 3)) OVER (PARTITION BY run ORDER BY us, seq ROWS UNBOUNDED PRECEDING)::DOUBLE AS s FROM s WHERE value IS NOT NULL),
w AS (SELECT *, greatest(s - 300, 0) AS o, CASE run % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE 0.6 END AS fx, CASE run % 4 WHEN 2 THEN 0.8 WHEN 3 THEN -0.8 ELSE 0.0 END AS fy FROM v),
t AS (SELECT run, seq, us, s, least(s, 300) - 300 + o * fx AS x, (seq % 3) * 0.5 + o * fy AS y FROM w),
rows_ AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run ORDER BY us, seq) AS i, count(*) OVER (PARTITION BY run) AS n FROM t)"""

ENDS = "en AS MATERIALIZED (SELECT 0 AS g, run, run * 2 + q.e AS k, x, y FROM rows_, (VALUES (0), (1)) q(e) WHERE (e = 0 AND i = 1) OR (e = 1 AND i = n))"
LINK, LEAST, RADIUS = 30.0, 3, 120.0
CENTRES = f"{ENDS}, {linked('en', LINK)}, ce AS MATERIALIZED (SELECT cluster AS centre, avg(x) AS x, avg(y) AS y, count(DISTINCT run) AS runs, count(*) AS n FROM lab JOIN en USING (k) GROUP BY cluster HAVING count(DISTINCT run) >= {LEAST})"
PASSAGES = f"""ins AS (SELECT r.run, centre, i, r.n FROM rows_ r JOIN ce ON sqrt((r.x - ce.x) ** 2 + (r.y - ce.y) ** 2) < {RADIUS}), grp AS (SELECT *, i - row_number() OVER (PARTITION BY run, centre ORDER BY i) AS c FROM ins),
pa AS MATERIALIZED (SELECT run, centre, min(i) - 1 AS first, max(i) AS last, max(i) = max(n) AS ends FROM grp GROUP BY run, centre, c HAVING min(i) > 1)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, seq, us, s, x, y, i, n."""
    w = Window.partitionBy("run").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    d = series(spark, sf_dir).where("value is not null")
    d = d.select("run", "seq", "us", F.sum(F.round(F.col("value") * 0.2, 3).cast("decimal(18,3)")).over(w).cast("double").alias("s"))
    o, k = F.greatest(F.col("s") - 300, F.lit(0.0)), F.col("run") % 4
    x = F.least("s", F.lit(300.0)) - 300 + o * F.when(k == 0, 0.0).when(k == 1, 1.0).otherwise(0.6)
    y = F.col("seq") % 3 * 0.5 + o * F.when(k == 2, 0.8).when(k == 3, -0.8).otherwise(0.0)
    return cut(terminals.numbered(d.withColumns({"x": x, "y": y}), SPAN))


@query(f"WITH RECURSIVE p AS (SELECT label AS g, vec_id AS k, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y FROM embeddings), {linked('p', 1.0)} SELECT g AS label, k AS vec_id, cluster FROM lab")
def single_link_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    xy = [(F.get("embedding", F.lit(k)).cast("double") * 100).alias(n) for k, n in enumerate("xy")]
    return clusters.linked_in_plane(table(spark, sf_dir, "embeddings").select("vec_id", "label", *xy), "vec_id", "x", "y", 1.0, by="label")


@query(f"WITH RECURSIVE {TRACK}, {CENTRES} SELECT centre, round(x, 6) AS x, round(y, 6) AS y, runs, n FROM ce")
def terminal_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = terminals.centres(tracks(spark, sf_dir), LINK, LEAST)
    return d.select("centre", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "runs", "n")


@query(f"WITH RECURSIVE {TRACK}, {CENTRES}, {PASSAGES} SELECT * FROM pa")
def terminal_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks(spark, sf_dir)
    return terminals.passages(rows, cut(terminals.centres(rows, LINK, LEAST)), RADIUS)


@query(f"""WITH RECURSIVE {TRACK}, {CENTRES}, {PASSAGES}, ar AS MATERIALIZED (SELECT pa.centre AS g, pa.run AS k, r.x, r.y, first, last FROM pa JOIN rows_ r ON pa.run = r.run AND r.i = r.n WHERE ends),
{linked('ar', 20.0, '2')},
m AS (SELECT g, arg_max(cluster, struct_pack(n := n, c := -cluster)) AS main FROM (SELECT g, cluster, count(*) AS n FROM lab2 GROUP BY g, cluster) GROUP BY g)
SELECT k AS run, g AS centre, first, last, cluster = main AS main FROM ar JOIN lab2 USING (g, k) JOIN m USING (g)""")
def terminal_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks(spark, sf_dir)
    found = terminals.passages(rows, cut(terminals.centres(rows, LINK, LEAST)), RADIUS)
    return terminals.arrivals(found, rows, 20.0)


@query()
def terminal_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map is the x axis up to 0; a run is a passage, and stands where its value is below 5.  Rows are some ten apart,
    and so are the steps of an axis."""
    rows = tracks(spark, sf_dir)
    points = rows.select(F.col("run").alias("passage"), "i", "s", "x", "y", (F.least("s", F.lit(300.0)) - 300).alias("cx"), F.lit(0.0).alias("cy"), (F.col("s") > 300).alias("held"))
    stands = rows.join(series(spark, sf_dir).where("value < 5").select("run", "seq"), ["run", "seq"]).select(F.col("run").alias("passage"), "s")
    found, _ = terminals.branches(points, stands, terminals.BranchRules(step=10.0, axis_join=12.0))
    return found
