"""Searches by bounds and cells, lists made distinct first, names after a row: against plain versions."""

import math
import random

from pyspark.sql import functions as F

from waymark.operators import etl, measuring, spatial_join, transit


def apart(lon1, lat1, lon2, lat2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371008.8 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def test_the_nearest_on_another_continent(spark):
    rng = random.Random(1)
    left = [(k, rng.uniform(-180, 180), rng.uniform(-89, 89)) for k in range(40)] + [(90, 179.9, 10.0), (91, 0.0, 89.9), (92, None, 1.0)]
    right = [(k, 10 + rng.gauss(0, 2), 48 + rng.gauss(0, 2)) for k in range(200)] + [(900, -179.5, 11.0), (901, -60.0, -40.0), (902, None, 5.0)]
    a = spark.createDataFrame(left, "k int, lon double, lat double")
    b = spark.createDataFrame(right, "p int, r_lon double, r_lat double")
    got = {r["k"]: r["best"] for r in spatial_join.nearest_anywhere(a, b, ["k"], F.col("p"), tie=F.col("p")).collect()}
    for k, x, y in left:
        want = None if x is None else min((apart(x, y, u, v), p) for p, u, v in right if u is not None)[1]
        assert got[k] == want, (k, x, y)


def test_nearest_in_the_plane_keeps_every_row(spark):
    a = spark.createDataFrame([(1, 139.0, 35.0), (2, None, 35.0), (3, 150.0, 40.0)], "k int, lon double, lat double")
    b = spark.createDataFrame([(7, 139.1, 35.0), (8, 139.2, 35.0)], "p int, r_lon double, r_lat double")
    near = lambda right: {r["k"]: r["p"] for r in spatial_join.nearest_in_plane(a, right, ["k"], "p").collect()}
    assert near(b) == {1: 7, 2: None, 3: 8} and near(b.limit(0)) == {1: None, 2: None, 3: None}


def test_the_nearest_line_in_the_window(spark):
    rng = random.Random(3)
    lines = [(k, [{"x": 139 + rng.random(), "y": 35 + rng.random()} for _ in range(rng.randint(2, 5))]) for k in range(12)]
    points = [(k, 138.5 + 2 * rng.random(), 34.5 + 2 * rng.random()) for k in range(60)] + [(99, 100.0, 0.0), (98, None, 35.0)]
    p, s = spark.createDataFrame(points, "p int, lon double, lat double"), spark.createDataFrame(lines, "l int, line array<struct<x:double,y:double>>")
    every = {r["p"]: (r["l"], r["m"]) for r in measuring.nearest_line(p, s, "p", "l", 5e6).collect()}
    some = {r["p"]: (r["l"], r["m"]) for r in measuring.nearest_line(p, s, "p", "l", 20_000.0).collect()}
    for k, x, y in points[:60]:
        best = min((math.inf, 0), *((far(x, y, a, b), n) for n, line in lines for a, b in zip(line, line[1:], strict=False)))
        assert every[k][0] == best[1] and abs(every[k][1] - best[0]) < 1
        assert best[0] > 20_000 or some[k] == every[k]  # beyond the window, only segments whose boxes meet it count
    assert 99 not in some and 98 not in every


def far(x, y, a, b):
    """Metres to a segment, the nearest point taken in a plane scaled at the point's latitude."""
    k = math.cos(math.radians(y))
    ux, uy, vx, vy = (a["x"] - x) * k, a["y"] - y, (b["x"] - a["x"]) * k, b["y"] - a["y"]
    t = max(0, min(1, -(ux * vx + uy * vy) / (vx * vx + vy * vy)))
    return apart(x, y, a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"]))


def test_the_next_three_names(spark):
    rows = [("p", k, 9 - k // 2, None if k == 2 else f"n{k}") for k in range(10)] + [("q", 1, 5, "only"), ("q", 2, 3, "too broad")]
    out = etl.suggestions(spark.createDataFrame(rows, "place string, relation int, level int, label string"))
    got = {(r["place"], r["n"]): (r["label"], r["context"]) for r in out.collect()}
    assert got == {("p", 1): ("n0", "n1, n3, n4"), ("p", 2): ("n1", "n3, n4, n5"), ("p", 3): (None, "n3, n4, n5"), ("p", 4): ("n3", "n4, n5, n6"), ("q", 1): ("only", "")}


def test_stations_merge_lists_once_each(spark):
    rows = [("m", "osm", 1, "a", "N", "", 1.0, 2.0, ["r2", "r1"], ["red", "blue"]), ("m", "gtfs", 2, "b", "G", "E", 3.0, 4.0, ["r1"], ["blue", "green"]), ("m", "osm", 0, "a", "O", "F", 5.0, 6.0, None, []), ("z", "osm", 9, "c", "Z", None, 0.0, 0.0, [], None)]
    df = spark.createDataFrame(rows, "merge_key string, source_kind string, ord int, id string, name string, name_en string, lon double, lat double, route_ids array<string>, colours array<string>")
    got = {r["merge_key"]: r for r in transit.merge_stations(df).collect()}
    m = got["m"]
    assert (m["name"], m["name_en"], m["lon"], m["source_ids"], m["route_ids"], m["colours"]) == ("G", "E", 3.0, ["a", "b"], ["r1", "r2"], ["blue", "green", "red"])
    assert (got["z"]["route_ids"], got["z"]["colours"], got["z"]["name_en"]) == ([], [], None)


def test_covering_boxes_by_cell(spark):
    rng = random.Random(4)
    boxes = [(k, x := rng.uniform(0, 5), y := rng.uniform(0, 5), x + rng.uniform(0.1, 3), y + rng.uniform(0.1, 3)) for k in range(30)]
    points = [(k, rng.uniform(0, 8), rng.uniform(0, 8)) for k in range(80)]
    b = spark.createDataFrame(boxes, "area int, w double, s double, e double, n double").select("area", F.struct("w", "s", "e", "n").alias("box"))
    got = {r["p"]: r["area"] for r in spatial_join.covering_box(spark.createDataFrame(points, "p int, lon double, lat double"), b, ["p"], "area").collect()}
    for k, x, y in points:
        want = min(((round((e - w) * (n - s), 12), a) for a, w, s, e, n in boxes if w <= x <= e and s <= y <= n), default=(0, None))[1]
        assert got.get(k) == want
