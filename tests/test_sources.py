"""Readers and writers on small files."""

import json

from seriesloom.sources import sinks, tables


def test_map_readers(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"points": [{"x": 1.0, "y": 2.0, "z": 3.0}, {"x": 4.0, "y": 5.0, "z": 6.0}], "paths": [{"point_indices": [1, 0]}]}))
    assert [tuple(r) for r in tables.path_graph(spark, f"{tmp_path}/g.json").orderBy("pos").collect()] == [(0, 0, 4.0, 5.0, 6.0), (0, 1, 1.0, 2.0, 3.0)]
    line = {"type": "LineString", "coordinates": [[1, 2], [3, 4, 5]]}
    many = {"type": "MultiLineString", "coordinates": [[[7, 8], [9, 9]]]}
    (tmp_path / "l.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"geometry": line}, {"geometry": many}, {"geometry": {"type": "Point", "coordinates": [0, 0]}}]}))
    got = [tuple(r) for r in tables.geojson_lines(spark, f"{tmp_path}/l.json").orderBy("line", "pos").collect()]
    assert got == [("0.0", 0, 1.0, 2.0, None), ("0.0", 1, 3.0, 4.0, 5.0), ("1.0", 0, 7.0, 8.0, None), ("1.0", 1, 9.0, 9.0, None)]
    (tmp_path / "c.csv").write_text("line,pos,lat,lon\na,0,1.5,2\na,1,x,3\n")
    assert [tuple(r) for r in tables.csv_lines(spark, f"{tmp_path}/c.csv").collect()] == [("a", 0, 1.5, 2.0), ("a", 1, None, 3.0)]


def test_writers(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "k int, s string"), spark.createDataFrame([(2, 0.1234567891)], "k int, v double")
    both = sinks.union_of_keys([a, b])
    assert both.columns == ["k", "s", "v"]
    assert sorted(r.json for r in sinks.canonical_json(both).collect()) == ['{"k":1,"s":"x","v":null}', '{"k":2,"s":null,"v":0.123457}']
    runs = spark.createDataFrame([("r1", 1), ("r2", 2)], "run string, v int")
    sinks.write_new_runs(runs, None, f"{tmp_path}/o")
    sinks.write_new_runs(runs, spark.read.parquet(f"{tmp_path}/o"), f"{tmp_path}/o")
    assert spark.read.parquet(f"{tmp_path}/o").count() == 2
    t = spark.createDataFrame([(1, 0), (1, 5), (1, 11), (2, 3)], "run int, us long")
    assert sinks.first_seconds(t, 10).count() == 3
