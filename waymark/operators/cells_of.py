"""Voronoi cells by neighbourhood, cut to play areas of any shape.

A candidate's cell is settled once no candidate outside the searched square can reach it: all its corners lie nearer than half
the square's reach (the security radius). Candidates meet by grid cells of that size; those not settled search a square of
twice the size. So a question with very many candidates spreads over tasks, and each cell costs its neighbours only. Candidates
with the same place and neighbours, as in questions that repeat, share one computed cell.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import kernels
from waymark.operators import arrangement
from waymark.operators.equals import once
from waymark.operators.spatial_join import cells
from waymark.operators.transit import first_by
from waymark.session import save

Box = tuple[float, float, float, float]


def _cut(ring: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """An open convex ring cut to what is nearer to own than to other."""
    normal, mid = own - other, (own + other) / 2
    side = (ring - mid) @ normal
    if (side >= 0).all():
        return ring
    nxt, side2 = np.roll(ring, -1, axis=0), np.roll(side, -1)
    cross = ((side > 0) & (side2 < 0)) | ((side < 0) & (side2 > 0))
    share = np.divide(side, side - side2, out=np.zeros_like(side), where=cross)
    both = np.stack([ring, ring + (nxt - ring) * share[:, None]], axis=1).reshape(-1, 2)
    return both[np.column_stack([side >= 0, cross]).ravel()]


def _cell(box: Box):
    """Column function: the cell of (lon, lat) among neighbours, cut to the box, and how far its corners lie."""
    w, s, e, n = box
    frame = np.array([(w, s), (e, s), (e, n), (w, n)], float)

    def one(x: float, y: float, near) -> tuple[list[dict], float]:
        own, ring = np.array([x, y]), frame
        others = np.array([(p["x"], p["y"]) for p in near], float).reshape(-1, 2) if near is not None else np.zeros((0, 2))
        far = np.hypot(*(others - own).T) if len(others) else np.zeros(0)
        for k in np.argsort(far, kind="stable"):
            if not far[k]:
                continue
            if far[k] / 2 > np.hypot(*(ring - own).T).max():
                break
            ring = _cut(ring, own, others[k])
            if len(ring) < 3:
                return [], 0.0
        closed = np.concatenate([ring, ring[:1]])
        return [{"x": float(a), "y": float(b)} for a, b in closed], float(np.hypot(*(ring - own).T).max())

    def run(lon: pd.Series, lat: pd.Series, near: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*v) for v in zip(lon, lat, near, strict=True)], columns=["cell", "far"])

    return F.pandas_udf(run, T.StructType([T.StructField("cell", kernels.LINE), T.StructField("far", T.DoubleType())]))


def voronoi(points: DataFrame, question: str, key: str, box: Box, first_deg: float | None = None) -> DataFrame:
    """(question, key, cell): each candidate's planar cell among its question's, cut to a box; of candidates in one place (6 decimals) the first by key.

    Candidates outside the box have what of their cell reaches into it, an empty cell if nothing does. Null places are left out.
    """
    p = points.filter("lon IS NOT NULL AND lat IS NOT NULL").withColumn("__x", F.round("lon", 6)).withColumn("__y", F.round("lat", 6))
    p = save(first_by(p, [question, "__x", "__y"], F.col(key)).select(question, key, "lon", "lat"))
    w, s, e, n = box
    if first_deg is None:  # about nine neighbours in the mean question
        mean = p.groupBy(question).agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n")).first()[0] or 1.0
        first_deg = 1.5 * math.sqrt((e - w) * (n - s) / mean)
    todo, done, r = p, None, first_deg
    whole = F.greatest(*(F.sqrt(F.pow(F.col("lon") - x, 2) + F.pow(F.col("lat") - y, 2)) for x in (w, e) for y in (s, n)))  # to the farthest corner
    while True:
        other = cells(p.select(question, F.col(key).alias("__k"), F.col("lon").alias("x"), F.col("lat").alias("y")), "x", "y", r)
        met = cells(todo, "lon", "lat", r, F.lit(r), F.lit(r)).join(other, [question, "cell_x", "cell_y"]).filter(F.col(key) != F.col("__k"))
        near = met.groupBy(question, key).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("near"))
        asked = save(todo.join(near, [question, key], "left").withColumn("last", 2 * whole <= r))
        made = save(once(asked.select(question, key, "lon", "lat", "near"), [question, key], ["lon", "lat", "near"], lambda d: d.withColumn("v", _cell(box)("lon", "lat", "near")).select(question, key, "v.cell", "v.far")))
        made = save(asked.drop("near").join(made, [question, key]))
        settled = (2 * F.col("far") <= r) | F.col("last")
        got = made.filter(settled).select(question, key, "cell")
        done = got if done is None else done.unionByName(got)
        todo, r = made.filter(~settled).select(question, key, "lon", "lat"), 2 * r
        if todo.isEmpty():
            return done


def clipped(found: DataFrame, question: str, key: str, areas: DataFrame, multi: str = "multi", grid: float = arrangement.GRID, cell: int | None = None) -> DataFrame:
    """The boundary (question, key, ax, ay, bx, by) of each cell within its question's play area, concave or with holes.

    areas: question, multi; one a question. Give it to ``arrangement.areas`` or ``arrangement.polygons``. The areas' boxes pass
    over cells that they miss; a cell outside its area has no edges.
    """
    both = found.select(question, key, "cell").join(areas.select(question, F.col(multi).alias("multi")), question)
    return clipped_pairs(both, [question, key], grid, cell)


def clipped_pairs(both: DataFrame, key: list[str], grid: float = arrangement.GRID, cell: int | None = None) -> DataFrame:
    """The boundary (key, ax, ay, bx, by) of each row's ``cell`` within the play area ``multi`` beside it."""
    both = both.filter(F.size("cell") > 3).withColumn("__cell", F.array(F.array("cell")))
    return arrangement.overlay(both.select(*key, F.col("__cell").alias("multi")), both.select(*key, "multi"), key, arrangement.intersection, "multi", grid, cell)
