"""Readers: the canonical event series, and map files in several formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    day = F.unix_date(ts.cast("date")).cast("long") * 86_400_000_000
    return day + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def series(spark: SparkSession, sf_dir: str, *topics: str) -> DataFrame:
    """run, topic, seq (arrival order), us (event time), value; NaN becomes null."""
    e = table(spark, sf_dir, "events")
    if topics:
        e = e.where(F.col("event_type").isin(*topics))
    value = F.when(~F.isnan("value"), F.col("value"))
    return e.select(F.col("user_id").alias("run"), F.col("event_type").alias("topic"), F.col("event_id").alias("seq"), micros(F.col("ts")).alias("us"), value.alias("value"))


def path_graph(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, x, y, z of a JSON path graph: points[{x, y, z}] and paths[{point_indices}]."""
    g = spark.read.option("multiLine", True).json(path)
    steps = g.select("points", F.posexplode("paths").alias("path", "p")).select("points", "path", F.posexplode("p.point_indices").alias("pos", "i"))
    at = F.get("points", F.col("i").cast("int"))
    return steps.select("path", "pos", at["x"].alias("x"), at["y"].alias("y"), at["z"].alias("z"))


def geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, pos, lon, lat, alt of the LineString and MultiLineString features of a GeoJSON file."""
    shape = "struct<features:array<struct<geometry:struct<type:string,coordinates:string>>>>"
    text = spark.read.text(path, wholetext=True)
    f = text.select(F.posexplode(F.from_json("value", shape)["features"]).alias("f", "x")).select("f", "x.geometry.*")
    one = F.from_json("coordinates", "array<array<double>>")
    many = F.from_json("coordinates", "array<array<array<double>>>")
    parts = f.where("type in ('LineString', 'MultiLineString')").select("f", F.posexplode(F.when(F.col("type") == "LineString", F.array(one)).otherwise(many)).alias("part", "line"))
    return parts.select("f", "part", F.posexplode("line").alias("pos", "c")).select(
        F.concat_ws(".", "f", "part").alias("line"), "pos", F.get("c", F.lit(0)).alias("lon"), F.get("c", F.lit(1)).alias("lat"), F.get("c", F.lit(2)).alias("alt")
    )


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, pos, lat, lon of a CSV file with a header; pos numbers the rows of a line by their own column or file order."""
    df = spark.read.option("header", True).csv(path)
    pos = F.col("pos").cast("long") if "pos" in df.columns else F.monotonically_increasing_id()
    return df.select(F.col("line"), pos.alias("pos"), F.expr("try_cast(lat as double)").alias("lat"), F.expr("try_cast(lon as double)").alias("lon"))


def run_list(df: DataFrame) -> DataFrame:
    """run, topic, rows, start, duration and the topic's share of the run's rows; one small row per run and topic."""
    g = df.groupBy("run", "topic").agg(F.count("*").alias("rows"), F.min("us").alias("start"), (F.max("us") - F.min("us")).alias("duration"))
    return g.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy("run")))


def typed(df: DataFrame, topic: str, payload: str, schemas: dict[str, str]) -> DataFrame:
    """Rows of the named topics with the fields of their JSON payload; a schema for each topic, all of one form of row."""
    names = list(dict.fromkeys(f.split()[0] for s in schemas.values() for f in s.split(", ")))
    parts = [df.where(F.col(topic) == t).withColumn("_p", F.from_json(payload, s)).select("*", "_p.*").drop("_p") for t, s in schemas.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*df.columns, *names)
