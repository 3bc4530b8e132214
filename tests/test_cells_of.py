"""Cells by neighbourhood against the version that looks at all candidates, and clipped to concave areas."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import kernels
from waymark.operators import arrangement, cells_of

BOX = (139.0, 35.0, 140.0, 36.0)


def area(line):
    xy = [(p["x"], p["y"]) for p in line]
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(xy, xy[1:], strict=False)) / 2)


@pytest.mark.parametrize("first", [None, 0.01, 3.0])
def test_cells_equal_those_from_all_candidates(spark, first):
    rng = random.Random(6)
    rows = [(0, k, 139 + rng.random(), 35 + rng.random()) for k in range(150)] + [(0, 500 + k, 139.5 + rng.gauss(0, 0.004), 35.2 + rng.gauss(0, 0.004)) for k in range(80)]
    rows += [(1, k, 139.2 + k * 0.1, 35.5) for k in range(6)] + [(1, 50, 139.2, 35.5), (2, 7, 139.9, 35.9), (3, 1, 150.0, 35.5), (3, 2, 139.5, 35.5), (4, 1, None, 35.0)]
    df = spark.createDataFrame(rows, "question int, key int, lon double, lat double")
    got = {(r["question"], r["key"]): area(r["cell"]) for r in cells_of.voronoi(df, "question", "key", BOX, first).collect()}
    want = {}
    for q in range(4):
        mine = sorted({(round(x, 6), round(y, 6)): (k, x, y) for g, k, x, y in sorted(rows, key=lambda r: -r[1]) if g == q and x is not None}.values())
        for (k, _, _), cell in zip(mine, kernels.voronoi([(x, y) for _, x, y in mine], BOX), strict=True):
            want[q, k] = area(cell)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-10) for k in want)


def test_cells_in_a_concave_area_with_a_hole(spark):
    rng = random.Random(8)
    rows = [(q, k, 139 + rng.random(), 35 + rng.random()) for q in range(2) for k in range(20)]
    ring = lambda *ps: [{"x": x, "y": y} for x, y in [*ps, ps[0]]]
    shape = [[ring((139.1, 35.1), (139.9, 35.1), (139.9, 35.4), (139.4, 35.4), (139.4, 35.9), (139.1, 35.9)), ring((139.2, 35.2), (139.2, 35.3), (139.3, 35.3), (139.3, 35.2))]]
    areas = spark.createDataFrame([(0, shape), (1, shape)], "question int, multi array<array<array<struct<x:double,y:double>>>>")
    df = spark.createDataFrame(rows, "question int, key int, lon double, lat double")
    edges = cells_of.clipped(cells_of.voronoi(df, "question", "key", BOX), "question", "key", areas)
    total = arrangement.areas(edges, ["question", "key"]).groupBy("question").agg(F.sum("area").alias("a"), F.count(F.lit(1)).alias("n")).collect()
    assert [r["a"] for r in total] == pytest.approx([0.8 * 0.3 + 0.3 * 0.5 - 0.01] * 2, abs=1e-6) and all(5 < r["n"] <= 20 for r in total)
