"""Operators whose rows SQL can't easily give, against plain versions over all pairs or one row at a time."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from waymark.functions import geo, kernels
from waymark.operators import search, sequences, spatial_join
from waymark.operators.graph import connected_components

LINE = "array<struct<x:double,y:double>>"
STATION = "id string, name string, name_en string, normalised string, wikidata string, operator string, tags map<string,string>, lon double, lat double, ord long"


def test_points_along_long_lines(spark):
    rng = np.random.default_rng(1)
    pts = rng.random((400, 2)) * [1, 1] + [139, 60]
    ends = [[(139.1, 60.1), (139.9, 60.8)], [(139.5, 60.0), (139.5, 61.0)], [(139.9, 60.5), (139.0, 60.5)], [(139.8, 60.9), (139.2, 60.0), (139.2, 60.0), (139.3, 60.9)]]
    lines = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in e]) for i, e in enumerate(ends)], f"line_id int, line {LINE}")
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)] + [(-1, None, 60.0)], "poi int, lon double, lat double")
    for degrees in (0.01, 0.3):
        got = {(r["line_id"], r["poi"]): round(r["m"], 3) for r in spatial_join.points_along_lines(points, lines, 4000.0, "poi", "line_id", degrees).collect()}
        want = {}
        for i, e in enumerate(ends):
            for a, b in zip(e, e[1:]):
                k = np.cos(np.radians(pts[:, 1]))
                d = np.subtract(b, a)
                n2 = (d[0] * k) ** 2 + d[1] ** 2
                t = np.clip(np.divide((pts[:, 0] - a[0]) * d[0] * k * k + (pts[:, 1] - a[1]) * d[1], n2, out=np.zeros(len(pts)), where=n2 > 0), 0, 1)
                m = sequences.metres(pts[:, 0], pts[:, 1], a[0] + t * d[0], a[1] + t * d[1])
                for p in np.flatnonzero(m <= 4000.0):
                    want[i, int(p)] = min(round(float(m[p]), 3), want.get((i, int(p)), 1e9))
        assert got == want and len(want) > 60


def test_freshest_cover(spark):
    rng = np.random.default_rng(2)
    spots = rng.random((12, 2)) * 0.2 + [139.0, 35.0]
    cached = [(i, int(rng.integers(0, 60)), "ab"[i % 2], *map(float, spots[rng.integers(0, 12)]), float(10 ** rng.uniform(1, 5))) for i in range(200)] + [(900, 70, "a", None, 35.0, 1e6), (901, 0, "b", 139.05, 35.05, 0.0)]
    asked = [(i, "abc"[i % 3], *map(float, spots[rng.integers(0, 12)]), float(10 ** rng.uniform(1, 4))) for i in range(150)] + [(990, "b", 139.05, 35.05, 0.0), (991, None, 139.05, 35.05, 0.0)]
    c = spark.createDataFrame(cached, "cached long, fetched_at long, category string, c_lon double, c_lat double, c_r double")
    q = spark.createDataFrame(asked, "request long, category string, lon double, lat double, r double")
    want = {}
    for r, cat, lon, lat, rad in asked:
        fits = [(t, k) for k, t, cc, x, y, cr in cached if cc == cat and x is not None and sequences.metres(x, y, lon, lat) * (geo.EARTH_M / sequences.EARTH_M) + rad <= cr]
        if fits:
            want[r] = max(fits)
    assert {r["request"]: (r["fetched_at"], r["cached"]) for r in search.freshest_covering(q, c).collect()} == want and len(want) > 60


def test_box_components(spark):
    rng = np.random.default_rng(3)
    at = [tuple(map(float, p)) for p in np.round(rng.random((160, 2)), 2)]
    at += at[:40]  # equal boxes
    boxes = spark.createDataFrame([(i, (x - 0.03, y - 0.03, x + 0.03, y + 0.03)) for i, (x, y) in enumerate(at)], "k int, box struct<w:double,s:double,e:double,n:double>")
    links = spatial_join.overlap_links(boxes, "k", 0.05)
    got = dict(map(tuple, connected_components(boxes.select(F.col("k").alias("node")), links).collect()))
    root = list(range(len(at)))
    for _ in at:
        for i, (x, y) in enumerate(at):
            for j, (u, v) in enumerate(at):
                if x - 0.03 <= u + 0.03 and u - 0.03 <= x + 0.03 and y - 0.03 <= v + 0.03 and v - 0.03 <= y + 0.03:
                    root[i] = root[j] = min(root[i], root[j])
    assert got == dict(enumerate(root)) and 1 < len(set(root)) < 120
    pairs = [tuple(r) for r in spatial_join.overlapping_boxes(boxes, "k", 0.05).collect()]
    assert len(pairs) == len(set(pairs))


def test_components_over_many_batches(spark):
    edges = spark.range(3000).select(F.concat(F.lit("n"), F.col("id")).alias("a"), F.concat(F.lit("n"), F.col("id") + 1).alias("b")).repartition(6)
    edges = edges.union(spark.createDataFrame([("x", "x"), (None, "n1")], "a string, b string"))
    nodes = spark.range(3001).select(F.concat(F.lit("n"), F.col("id")).alias("node")).union(spark.createDataFrame([("x",)], "node string"))
    got = connected_components(nodes, edges).groupBy("component").count().collect()
    assert {r["component"]: r["count"] for r in got} == {"n0": 3001, "x": 1}


def test_stations_of_a_name(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(300):
        x, y = rng.integers(0, 12), rng.integers(0, 12)
        rows.append((f"n{k}", "a", None, "ab"[k % 2], None, None, {}, 179.995 + 0.001 * float(x), 60.0 + 0.0007 * float(y), int(k)))
    rows += [("p1", "a", None, "a", None, None, {}, None, 60.0, 900), ("p2", "a", None, None, None, None, {}, 140.0, 60.0, 901)]
    got = {r["id"] for r in sequences.dedupe_stations(spark.createDataFrame(rows, STATION)).collect()}
    kept = defaultdict(list)
    for r in rows[:300]:
        if all(sequences.metres(a, b, r[7], r[8]) > 150 for _, a, b in kept[r[3]]):
            kept[r[3]].append((r[0], r[7], r[8]))
    assert got == {i for v in kept.values() for i, _, _ in v} | {"p1", "p2"} and len(got) < 200


def test_ways_of_a_relation(spark):
    rng = np.random.default_rng(5)
    ways = []
    for k in range(240):
        n = rng.integers(1, 4)
        ways.append((int(k % 3) or None, int(k), [(float(x), float(y)) for x, y in rng.integers(0, 6, (n, 2))]))
    df = spark.createDataFrame([(r, o, [{"x": x, "y": y} for x, y in w]) for r, o, w in ways], f"relation int, ord long, line {LINE}")
    got = {(r["relation"], r["part"]): [(p["x"], p["y"]) for p in r["line"]] for r in sequences.stitch_ways(df).collect()}
    want = {}
    for rel in {r for r, _, _ in ways}:
        left, part = [w for r, _, w in ways if r == rel and len(w) > 1], 0
        while left:
            line = left.pop(0)
            while (hit := next((w for w in left if {w[0], w[-1]} & {line[0], line[-1]}), None)) is not None:
                left.pop(next(k for k, w in enumerate(left) if w is hit))
                if line[-1] in (hit[0], hit[-1]):
                    line = line + (hit if hit[0] == line[-1] else hit[::-1])[1:]
                else:
                    line = (hit if hit[-1] == line[0] else hit[::-1])[:-1] + line
            want[rel, part], part = line, part + 1
    assert got == want and len(want) > 5


def test_cells_hold_what_is_nearest():
    rng = np.random.default_rng(6)
    xy = rng.random((300, 2))
    xy[7] = xy[3]
    cells = kernels.voronoi([tuple(p) for p in xy], (0, 0, 1, 1))
    assert cells[7] == cells[3]
    area = 0.0
    for k, cell in enumerate(cells):
        ring = np.array([(p["x"], p["y"]) for p in cell])
        x, y = ring.T
        area += 0 if k == 7 else float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)
        d = np.hypot(*(ring[:-1, None] - xy).transpose(2, 0, 1))  # no other point is nearer to a corner
        assert (d[:, k] <= d.min(1) + 1e-9).all()
    assert abs(area - 1) < 1e-9
