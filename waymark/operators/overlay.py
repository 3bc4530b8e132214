"""Overlay of polygons on a grid of cells: union, intersection, difference and dissolve as set operations on cell rows.

A polygon becomes the cells whose centres it holds; overlays are then grouped counts, and a dissolved shape is the rectangles
of neighbouring cells in a row. Work spreads by cell, a polygon of any size included, and the error is half a cell at edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import rings
from waymark.functions.geo import DEGREE_M


def rasterise(polygons: DataFrame, key: list[str], degrees: float, multi: str = "multi") -> DataFrame:
    """(key, cell_x, cell_y): cells whose centres lie in the polygon. Rows of a polygon's box spread before they are tested."""
    p = polygons.withColumn("__box", rings.bounds(F.flatten(F.flatten(F.col(multi)))))
    at = lambda v: F.floor(v / degrees).cast("long")
    p = p.withColumn("cell_y", F.explode(F.sequence(at(F.col("__box.s")), at(F.col("__box.n")))))
    p = p.withColumn("cell_x", F.explode(F.sequence(at(F.col("__box.w")), at(F.col("__box.e")))))
    x, y = (F.col("cell_x") + 0.5) * degrees, (F.col("cell_y") + 0.5) * degrees
    return p.filter(rings.point_in_multipolygon(x, y, F.col(multi))).select(*key, "cell_x", "cell_y")


def cell_m2(degrees: float) -> Column:
    return F.lit(degrees * degrees * DEGREE_M * DEGREE_M) * F.cos(F.radians((F.col("cell_y") + 0.5) * degrees))


def overlay(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, cell_x, cell_y, in_a, in_b) for two rasters: union is every row, intersection both, difference a and not b."""
    both = a.select(key, "cell_x", "cell_y", F.lit(True).alias("a"), F.lit(False).alias("b")).union(b.select(key, "cell_x", "cell_y", F.lit(False), F.lit(True)))
    return both.groupBy(key, "cell_x", "cell_y").agg(F.bool_or("a").alias("in_a"), F.bool_or("b").alias("in_b"))


def overlay_areas(a: DataFrame, b: DataFrame, key: str, degrees: float) -> DataFrame:
    """(key, union_m2, both_m2, only_a_m2, sym_diff): sym_diff is the part of the union that isn't shared."""
    m2 = cell_m2(degrees)
    o = overlay(a, b, key)
    out = o.groupBy(key).agg(F.sum(m2).alias("union_m2"), F.sum(F.when(F.col("in_a") & F.col("in_b"), m2).otherwise(0.0)).alias("both_m2"), F.sum(F.when(F.col("in_a") & ~F.col("in_b"), m2).otherwise(0.0)).alias("only_a_m2"))
    return out.withColumn("sym_diff", (F.col("union_m2") - F.col("both_m2")) / F.col("union_m2"))


def dissolve(raster: DataFrame, degrees: float, tile: int = 64) -> DataFrame:
    """(tile_x, tile_y, cells, w, s, e, n): distinct cells as rectangles, row by row within tiles of ``tile`` cells.

    Tiles are disjoint, so pieces only touch; a tile holds a bounded number of cells however many polygons overlap there.
    """
    c = raster.select("cell_x", "cell_y").distinct().withColumn("tile_x", F.floor(F.col("cell_x") / tile)).withColumn("tile_y", F.floor(F.col("cell_y") / tile))
    w = Window.partitionBy("tile_x", "tile_y", "cell_y").orderBy("cell_x")
    runs = c.withColumn("run", F.col("cell_x") - F.row_number().over(w)).groupBy("tile_x", "tile_y", "cell_y", "run").agg(F.count(F.lit(1)).alias("cells"), F.min("cell_x").alias("x0"), F.max("cell_x").alias("x1"))
    return runs.select("tile_x", "tile_y", "cells", (F.col("x0") * degrees).alias("w"), (F.col("cell_y") * degrees).alias("s"), ((F.col("x1") + 1) * degrees).alias("e"), ((F.col("cell_y") + 1) * degrees).alias("n"))


def bucket_by_centre(polygons: DataFrame, degrees: float = 0.1) -> DataFrame:
    """(bucket_x, bucket_y, polygons): whole polygons by the cell of their box's centre."""
    p = polygons.withColumn("__c", rings.box_centre_point(F.flatten(F.flatten(F.col("multi")))))
    p = p.withColumn("bucket_x", F.floor(F.col("__c.x") / degrees)).withColumn("bucket_y", F.floor(F.col("__c.y") / degrees))
    return p.groupBy("bucket_x", "bucket_y").agg(F.count(F.lit(1)).alias("polygons"))


def drop_small(polygons: DataFrame, least_m2: float) -> DataFrame:
    return polygons.filter(rings.multipolygon_area_m2(F.col("multi")) >= least_m2)
