"""What rounding must not decide: points on edges, at ends and at equal distances."""

from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import transit


def test_a_segment_that_ends_on_another_does_not_cross_it(spark):
    diagonal = (139.1, 35.1, 139.9, 35.9)
    segments = [(139.8081, 35.1271, 139.6, 35.6), (139.6, 35.6, 139.3919, 35.0729), (139.5, 35.6, 139.6, 35.5)]
    rows = spark.createDataFrame([(i, *map(float, s)) for i, s in enumerate(segments)], "i int, ax double, ay double, bx double, by double")
    got = [r[0] for r in rows.select("i", F.round(geo.segment_crossing("ax", "ay", "bx", "by", *diagonal), 6).alias("t")).orderBy("i").select("t").collect()]
    assert got == [None, None, 0.5]


def test_lines_are_cut_at_corners_but_not_at_vertices_on_the_edge(spark):
    box = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    lines = {1: [(0.5, 0.5), (2.0, 2.0)], 2: [(0.5, 0.5), (1.0, 0.5), (2.0, 0.5)], 3: [(-1.0, 0.5), (0.0, 0.5), (0.5, 0.5)], 4: [(2.0, 0.0), (0.5, 0.75), (0.0, 2.0)]}
    rows = spark.createDataFrame([(k, i, x, y, [box]) for k, line in lines.items() for i, (x, y) in enumerate(line)], "k int, seq int, x double, y double, area array<array<struct<x: double, y: double>>>")
    rows = rows.withColumn("area", F.array("area"))
    got = {(r["k"], r["run"]): [(round(p["x"], 6), round(p["y"], 6)) for p in r["line"]] for r in transit.outside_runs(rows, "k", "area").collect()}
    assert got == {(1, 0): [(1.0, 1.0), (2.0, 2.0)], (2, 1): [(1.0, 0.5), (2.0, 0.5)], (4, 0): [(2.0, 0.0), (1.0, 0.5)], (4, 1): [(0.4, 1.0), (0.0, 2.0)]}
