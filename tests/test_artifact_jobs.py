"""Artifacts are written once for each content, again after a change or a cut-off run, and read back as built."""

import os

from pyspark.sql import functions as F

from waymark.functions import kernels
from waymark.operators import artifact_jobs as jobs

AREA = "area long, area_name string, level int, multi array<array<array<struct<x:double,y:double>>>>"


def ring(*points):
    return [{"x": x, "y": y} for x, y in [*points, points[0]]]


def tables(spark, name="A"):
    square = [[ring((0.0, 0.0), (1.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]]
    areas = spark.createDataFrame([(1, name, 2, square), (2, "B", 3, [[ring((5.0, 5.0), (6.0, 5.0))]]), (3, "C", 2, None)], AREA)
    lines = spark.createDataFrame([("coast", "l1", ring((0.0, 0.0), (0.5, 0.5))), ("coast", "l2", [{"x": 1.0, "y": 1.0}])], "category string, id string, line array<struct<x:double,y:double>>")
    frame = spark.createDataFrame
    relations = {
        "routes": frame([("r", {"name": "N", "route": "train"}), ("q", {})], "relation string, tags map<string,string>"), "masters": frame([], "relation string, tags map<string,string>, members array<string>"),
        "members": frame([("r", i, "node", f"n{i}", "stop", None, None, None) for i in range(3)], "relation string, seq int, type string, ref string, role string, name_key string, lon double, lat double"),
        "stations": frame([(f"n{i}", f"n{i}", "station", 139.0 + i / 100, 35.0) for i in range(3)], "station string, name_key string, kind string, s_lon double, s_lat double"),
    }
    return areas, lines, relations


def written(built):
    return {k: w for k, (_, w) in built.items()}


def test_a_second_run_writes_nothing_and_a_change_only_what_it_touches(spark, tmp_path):
    folder = f"file://{tmp_path}/region"
    first = jobs.build_region(folder, *tables(spark))
    assert written(first) == {"boundaries": True, "measuring": True, "transit": True}
    before = {f: os.stat(f).st_mtime_ns for d, _, fs in os.walk(tmp_path) for f in (os.path.join(d, x) for x in fs)}
    areas, lines, relations = tables(spark)
    again = jobs.build_region(folder, areas.repartition(3), lines.orderBy(F.desc("id")), relations)
    assert written(again) == {"boundaries": False, "measuring": False, "transit": False}
    assert before == {f: os.stat(f).st_mtime_ns for d, _, fs in os.walk(tmp_path) for f in (os.path.join(d, x) for x in fs)}
    other = jobs.build_region(folder, tables(spark, "renamed")[0], lines, relations)
    assert written(other) == {"boundaries": True, "measuring": True, "transit": False}
    assert {r["kind"]: r["rows"] for r in jobs.report(spark, other).collect()} == {"boundaries": 1, "measuring": 3, "transit": 1}


def test_what_is_read_back_and_a_run_that_was_cut_off(spark, tmp_path):
    folder = f"file://{tmp_path}/region"
    built = jobs.build_region(folder, *tables(spark))
    b = built["boundaries"][0].select("name", "points", kernels.decode_delta("code").alias("multi"), "e").first()
    assert (b["name"], b["points"], b["e"]) == ("A", 5, 1.0) and [(p["x"], p["y"]) for p in b["multi"][0][0]] == [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    assert sorted((r["category"], r["id"], r["points"]) for r in built["measuring"][0].collect()) == [("admin-2", "1:0", 5), ("admin-3", "2:0", 3), ("coast", "l1", 3)]
    t = built["transit"][0].first()
    assert t["stations"] == ["n0", "n1", "n2"] and t["codes"] == [[139000000, 35000000, 3, 10000, 0, 10000, 0]]
    for d, _, fs in os.walk(tmp_path):
        if "boundaries-" in d and "_SUCCESS" in fs:
            os.remove(os.path.join(d, "_SUCCESS"))
    assert written(jobs.build_region(folder, *tables(spark))) == {"boundaries": True, "measuring": False, "transit": False}
