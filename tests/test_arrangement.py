"""Overlays, dissolves, repairs and buffers against areas added up strip by strip, and against closed forms."""

import math
import random

import numpy as np
import pytest

from waymark.operators import arrangement as arr

SHAPE = "k int, multi array<array<array<struct<x:double,y:double>>>>"
LINE = "k int, line array<struct<x:double,y:double>>"
RULES = {"union": arr.union, "intersection": arr.intersection, "difference": arr.difference, "sym": arr.symmetric_difference}
TAKES = {"union": lambda a, b: a or b, "intersection": lambda a, b: a and b, "difference": lambda a, b: a and not b, "sym": lambda a, b: a != b}


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def strips(layers, takes, inside=lambda w: w > 0):
    """The area that a rule takes, by trapezoids between all ends and crossings. layers: rings of each layer, each counter-clockwise."""
    edges = [(np.array(p, float), np.array(q, float), n) for n, rings in enumerate(layers) for r in rings for p, q in zip(r, [*r[1:], r[0]], strict=True) if tuple(p) != tuple(q)]
    xs = {float(p[0]) for p, _, _ in edges}
    for i, (a, b, _) in enumerate(edges):
        for c, d, _ in edges[:i]:
            u, v, w = b - a, d - c, c - a
            den = u[0] * v[1] - u[1] * v[0]
            if den:
                t, s = (w[0] * v[1] - w[1] * v[0]) / den, (w[0] * u[1] - w[1] * u[0]) / den
                if 0 <= t <= 1 and 0 <= s <= 1:
                    xs.add(float(a[0] + t * u[0]))
    xs, total = sorted(xs), 0.0
    for x0, x1 in zip(xs, xs[1:], strict=False):
        mid = (x0 + x1) / 2
        across = sorted((a[1] + (b[1] - a[1]) * (mid - a[0]) / (b[0] - a[0]), 1 if a[0] < b[0] else -1, n) for a, b, n in edges if (a[0] < mid) != (b[0] < mid))
        w = [0] * max(2, len(layers))
        for (y, s, n), up in zip(across, across[1:], strict=False):
            w[n] += s
            if takes(inside(w[0]), inside(w[1])):
                total += (up[0] - y) * (x1 - x0)
    return total


def ccw(points):
    a = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, [*points[1:], points[0]], strict=True))
    return points if a > 0 else points[::-1]


def shapes(seed, n):
    """Triangles and slanted boxes on a coarse grid, so that corners, edges and crossings coincide often, and some on a fine one."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        q = rng.choice([0.1, 0.1, 0.0137])
        x, y = rng.randint(0, 30) * q, rng.randint(0, 30) * q
        if rng.random() < 0.5:
            w, h = rng.randint(1, 9) * q, rng.randint(1, 9) * q
            r = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        else:
            r = [(x, y), (x + rng.randint(1, 9) * q, y + rng.randint(-4, 4) * q), (x + rng.randint(-4, 9) * q, y + rng.randint(5, 9) * q)]
        out.append(ccw([(round(a, 8), round(b, 8)) for a, b in r]))
    return out


@pytest.mark.parametrize("cell", [None, 3_000_000, 40_000_000])
def test_overlays_of_many_shapes(spark, cell):
    sets = {k: (shapes(k, 12), shapes(100 + k, 12)) for k in range(3)}
    frame = lambda side: spark.createDataFrame([(k, [[ring(r[:: random.Random(k).choice([1, -1])])] for r in s[side]]) for k, s in sets.items()], SHAPE)
    both = arr.arranged_pair(frame(0), frame(1), ["k"], cell=cell)
    for name, rule in RULES.items():
        edges = arr.select(both, ["k"], rule)
        got = {r["k"]: r["area"] for r in arr.areas(edges, ["k"]).collect()}
        for k, (a, b) in sets.items():
            assert got[k] == pytest.approx(strips([a, b], TAKES[name]), abs=2e-7), (name, k)
        if cell is None and name == "sym":
            parts = arr.polygons(edges, ["k"]).collect()
            assert all(p["area"] > 0 for p in parts)
            for k in sets:
                assert math.fsum(p["area"] for p in parts if p["k"] == k) == pytest.approx(got[k], abs=1e-9)


def test_a_dissolve_is_the_same_at_every_cell_size(spark):
    sets = [(k, [[ring(r)] for r in shapes(7 + k, 25)]) for k in range(2)]
    df = spark.createDataFrame(sets, SHAPE)
    found = []
    for cell in (None, 2_000_000, 90_000_000):
        rows = arr.ring_rows(arr.dissolve(df, ["k"], cell=cell), ["k"]).collect()
        found.append(sorted((r["k"], round(r["area"], 12), tuple((p["x"], p["y"]) for p in r["line"])) for r in rows))
    assert found[0] == found[1] == found[2] and len(found[0]) > 2


def test_borders_of_neighbours_cancel_and_holes_stay(spark):
    square = lambda x, y, s=1.0: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    frame = [[ring(square(x, y))] for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    island = [[ring(square(1.25, 1.25, 0.5))]]
    df = spark.createDataFrame([(1, frame + island), (2, [[ring(square(0, 0, 4)), ring(square(1, 1, 2)[::-1])], [ring(square(1.5, 1.5))]]), (3, None), (4, []), (5, [[ring(square(0, 0))[:2]]])], SHAPE)
    out = arr.polygons(arr.dissolve(df, ["k"]), ["k"]).collect()
    got = sorted((r["k"], len(r["polygon"]), round(r["area"], 9), len(r["polygon"][0])) for r in out)
    assert got == [(1, 1, 0.25, 5), (1, 2, 8.0, 5), (2, 1, 1.0, 5), (2, 2, 12.0, 5)]


def test_repair_of_bow_ties_spikes_and_repeats(spark):
    bow = [(0, 0), (2, 2), (2, 0), (0, 2)]
    spike = [(0, 0), (4, 0), (4, 1), (9, 1), (4, 1), (4, 4), (0, 4)]
    doubled = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0), (1, 0), (1, 1), (0, 1), (0, 0), (3, 0), (3, 3), (0, 3)]
    star = [(math.cos(4 * math.pi * i / 5), math.sin(4 * math.pi * i / 5)) for i in range(5)]
    df = spark.createDataFrame([(k, [[ring(r)]]) for k, r in enumerate([bow, spike, doubled, star])], SHAPE)
    edges = arr.repair(df, ["k"])
    area = {r["k"]: r["area"] for r in arr.areas(edges, ["k"]).collect()}
    parts = [r["k"] for r in arr.polygons(edges, ["k"]).collect()]
    odd = strips([[star]], lambda a, b: a, lambda w: w % 2 != 0)
    assert [round(area[k], 7) for k in range(3)] == [2.0, 16.0, 9.0] and area[3] == pytest.approx(abs(odd), abs=1e-7)
    assert [parts.count(k) for k in range(4)] == [2, 1, 1, 5]


def plane(lon, lat, east, north):
    """A point so many metres from another, in its local plane."""
    return lon + east / (111320 * math.cos(math.radians(lat))), lat + north / 111320


def test_buffers_of_segments_bends_and_points(spark):
    r, n = 300.0, 32
    disc = n / 2 * r * r * math.sin(2 * math.pi / n)
    at = lambda *p: [dict(zip("xy", plane(139.5, 35.5, e, m), strict=True)) for e, m in p]
    rows = [(0, at((-2000, 0), (2000, 0))), (1, at((0, 0))), (2, at((-1500, -1500), (1500, 1500))), (3, at((0, -1000), (0, 0), (0, 0), (0, 1000))), (4, []), (5, None)]
    df = spark.createDataFrame(rows, LINE)
    edges = arr.buffers(df, ["k"], r)
    scale = 111320**2 * math.cos(math.radians(35.5))
    got = {x["k"]: x["area"] * scale for x in arr.areas(edges, ["k"]).collect()}
    assert set(got) == {0, 1, 2, 3}
    for k, length in ((0, 4000), (1, 0), (2, 3000 * math.sqrt(2)), (3, 2000)):
        assert got[k] == pytest.approx(2 * r * length + disc, rel=2e-6), k


def test_a_buffer_holds_what_is_near_and_nothing_else(spark):
    """Random bent lines, sharp bends and loops among them: points within the radius lie inside, points beyond lie outside."""
    rng = random.Random(3)
    lines = [[(rng.uniform(-900, 900), rng.uniform(-900, 900)) for _ in range(rng.randint(2, 9))] for _ in range(8)] + [[(0, 0), (800, 0), (10, 30), (800, 60), (0, 0)]]
    df = spark.createDataFrame([(k, [dict(zip("xy", plane(139.5, 0.0, *p), strict=True)) for p in line]) for k, line in enumerate(lines)], LINE)
    rings = arr.ring_rows(arr.buffers(df, ["k"], 150.0, steps=16), ["k"]).collect()
    for k, line in enumerate(lines):
        mine = [[((p["x"] - 139.5) * 111320, p["y"] * 111320) for p in x["line"]] for x in rings if x["k"] == k]
        for _ in range(300):
            x, y = rng.uniform(-1200, 1200), rng.uniform(-1200, 1200)
            far = min(apart(x, y, *a, *b) for a, b in zip(line, line[1:], strict=False))
            if abs(far - 150) < 2:
                continue
            inside = sum(((a[1] > y) != (b[1] > y)) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for r in mine for a, b in zip(r, r[1:], strict=False)) % 2 == 1
            assert inside == (far < 150), (k, x, y, far)


def apart(x, y, ax, ay, bx, by):
    d = (bx - ax) ** 2 + (by - ay) ** 2
    t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / d)) if d else 0
    return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))


def test_dilation_of_a_square_with_a_hole(spark):
    box = lambda h: [plane(139.5, 35.5, e, n) for e, n in ((-h, -h), (h, -h), (h, h), (-h, h))]
    df = spark.createDataFrame([(1, [[ring(box(2000)), ring(box(1000)[::-1])]]), (2, [[ring(box(2000)), ring(box(100)[::-1])]])], SHAPE)
    edges = arr.dilate(df, ["k"], 200.0)
    scale = 111320**2 * math.cos(math.radians(35.5))
    got = {x["k"]: x["area"] * scale for x in arr.areas(edges, ["k"]).collect()}
    outer = 4000**2 + 4 * 4000 * 200 + 16 * 200**2 * math.sin(2 * math.pi / 32)
    assert got[1] == pytest.approx(outer - 1600**2, rel=1e-6) and got[2] == pytest.approx(outer, rel=1e-6)
    assert sorted(len(p["polygon"]) for p in arr.polygons(edges, ["k"]).collect()) == [1, 2]


def test_edges_too_long_and_nothing_at_all(spark):
    with pytest.raises(ValueError, match="coarser"):
        arr.dissolve(spark.createDataFrame([(1, [[ring([(0, 0), (170, 0), (170, 80)])]])], SHAPE), ["k"])
    wide = arr.dissolve(spark.createDataFrame([(1, [[ring([(0, 0), (170, 0), (170, 80)])]])], SHAPE), ["k"], grid=1e-6)
    none = arr.dissolve(spark.createDataFrame([], SHAPE), ["k"])
    assert none.count() == 0 and arr.areas(none, ["k"]).count() == 0 and arr.polygons(none, ["k"]).count() == 0
    assert arr.areas(wide, ["k"], 1e-6).first()["area"] == pytest.approx(6800.0)
