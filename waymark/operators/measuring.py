"""Measuring: line bundles, windows around a play area, distance to lines and areas, and checks of stitched lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo, rings
from waymark.functions.geo import DEGREE_M
from waymark.operators.graph import connected_components
from waymark.operators.spatial_join import box_cells, cells, reach, segment_cells, segments, within_distance
from waymark.session import save

#: How far from a seeker lines are considered, and categories that read other bundles too.
WINDOW_M = 50_000.0
EXTRA_SOURCES = {"body-of-water": ("body-of-water", "coastline")}


def sources_of(category: str) -> tuple[str, ...]:
    return EXTRA_SOURCES.get(category, (category,))


def merge_bundles(bundles: DataFrame) -> DataFrame:
    """(category, features, box, source) of all packs' bundles: counts added, extents united, distinct sources joined by ``; ``."""
    b = bundles.groupBy("category").agg(
        F.sum("features").alias("features"), F.min("box.w").alias("w"), F.min("box.s").alias("s"), F.max("box.e").alias("e"), F.max("box.n").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), "; ").alias("source")
    )
    return b.select("category", "features", geo.bbox("w", "s", "e", "n").alias("box"), "source")


def border_lines(boundaries: DataFrame, level: int) -> DataFrame:
    """Every ring, holes too, of the boundaries at a level as a line with its box: relation, ring, line, box."""
    r = boundaries.filter(F.col("level") == level).select(F.col("area").alias("relation"), F.posexplode(F.flatten("multi")).alias("ring", "line"))
    return r.withColumn("box", rings.bounds(F.col("line")))


def outer_lines(boundaries: DataFrame) -> DataFrame:
    """Only the outer rings of 4 points or more."""
    r = boundaries.select(F.col("area").alias("relation"), F.posexplode(F.transform("multi", lambda p: F.get(p, F.lit(0)))).alias("part", "line"))
    return r.filter(F.size("line") >= 4)


def in_window(features: DataFrame, play_area: Column, metres: float) -> DataFrame:
    """Features whose box meets the play area's, padded by metres."""
    return features.filter(geo.boxes_meet(F.col("box"), geo.window_box(play_area, metres)))


def nearest_line(points: DataFrame, lines: DataFrame, point: str, line: str, window_m: float = WINDOW_M, first_m: float = 2000.0) -> DataFrame:
    """(point, line, m): the nearest line with a segment whose box meets the seeker's window, a box padded by ``window_m``; points
    with none in it have no row.

    Segments enter the cells that they pass within a radius, points their own; the radius grows fourfold for points that
    found nothing, and the last round takes the cells of whole boxes.
    """
    s = save(segments(lines, [line]).withColumn("sbox", geo.bbox(F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by"))))
    todo, done, r = save(points.select(point, "lon", "lat").filter("lon IS NOT NULL AND lat IS NOT NULL")), None, first_m
    far = geo.point_segment_haversine_m("lon", "lat", "ax", "ay", "bx", "by")
    while not todo.isEmpty():
        size = min(r, window_m) / DEGREE_M
        if r < window_m:
            tiles = segment_cells(s, size, *reach(r, F.greatest(F.abs("ay"), F.abs("by"))))
            both = cells(todo, "lon", "lat", size).join(tiles, ["cell_x", "cell_y"]).withColumn("m", far).filter(F.col("m") <= r)
        else:
            window = todo.withColumn("pbox", geo.window_box(geo.bbox("lon", "lat", "lon", "lat"), window_m))
            both = box_cells(window, F.col("pbox"), size).join(box_cells(s, F.col("sbox"), size), ["cell_x", "cell_y"]).filter(geo.boxes_meet(F.col("sbox"), F.col("pbox"))).withColumn("m", far)
        found = save(both.groupBy(point).agg(F.min_by(line, F.struct("m", line)).alias(line), F.min("m").alias("m")))
        done = found if done is None else done.unionByName(found)
        if r >= window_m:
            break
        todo, r = save(todo.join(found, point, "left_anti")), 4 * r
    return done if done is not None else todo.select(point).join(lines.select(line).limit(0), F.lit(False)).withColumn("m", F.lit(0.0))


def distance_to_areas(points: DataFrame, areas: DataFrame, point: str) -> DataFrame:
    """(point, m): 0 inside any area, else metres to the nearest ring within the seeker's window of 50 km, else null. areas: (area, box, multi)."""
    from waymark.operators.spatial_join import points_in_polygons

    inside = points_in_polygons(points, areas).select(point).distinct().withColumn("inside", F.lit(True))
    lines = areas.select("area", F.explode(F.flatten("multi")).alias("line"))
    near = nearest_line(points, lines, point, "area")
    return points.select(point).join(inside, point, "left").join(near, point, "left").select(point, F.when(F.col("inside"), 0.0).otherwise(F.col("m")).alias("m"))


def continuity(lines: DataFrame, ends_m: float = 25.0, least_m: float = 1000.0) -> DataFrame:
    """(components, lines): groups of lines of 1 km or more whose ends lie within 25 m of each other. lines: (line_id, line)."""
    long_ = lines.filter(rings.length_m(F.col("line")) >= least_m)
    ends = long_.select("line_id", F.explode(F.array(F.element_at("line", 1), F.element_at("line", -1))).alias("p")).select("line_id", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))
    other = ends.select(F.col("line_id").alias("b"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    edges = within_distance(ends.withColumnRenamed("line_id", "a"), other, ends_m).filter("a < b").select("a", "b").distinct()
    parts = connected_components(long_.select(F.col("line_id").alias("node")), edges)
    return parts.agg(F.countDistinct("component").alias("components"), F.count(F.lit(1)).alias("lines"))


def interior_holes(lines: DataFrame, box: Column, least_m: float = 1000.0, hole_m: tuple[float, float] = (40.0, 2500.0), edge_deg: float = 0.02) -> DataFrame:
    """(a, b, x, y, gap): ends of two long lines that face each other across a gap, away from the box's edges; a < b.

    The ends' tangents, each into its own line, are nearly opposite, and the gap opens in front of a's end. Ends meet by cell
    within the widest gap. lines: (line_id, line).
    """
    line = F.col("line")
    long_ = lines.filter((F.size(line) >= 2) & (rings.length_m(line) >= least_m))
    end = lambda k, j: F.struct(F.element_at(line, k).alias("p"), F.element_at(line, j).alias("q"))
    ends = long_.select("line_id", F.explode(F.array(end(1, 2), end(-1, -2))).alias("v")).select("line_id", F.col("v.p.x").alias("lon"), F.col("v.p.y").alias("lat"), (F.col("v.q.x") - F.col("v.p.x")).alias("dx"), (F.col("v.q.y") - F.col("v.p.y")).alias("dy"))
    n = F.nullif(F.hypot("dx", "dy"), F.lit(0.0))
    ends = ends.withColumn("tx", F.coalesce(F.col("dx") / n, F.lit(0.0))).withColumn("ty", F.coalesce(F.col("dy") / n, F.lit(0.0)))
    off = (F.col("lon") - box["w"] >= edge_deg) & (box["e"] - F.col("lon") >= edge_deg) & (F.col("lat") - box["s"] >= edge_deg) & (box["n"] - F.col("lat") >= edge_deg)
    ends = ends.filter(off)
    left = ends.select(F.col("line_id").alias("a"), "lon", "lat", F.col("tx").alias("ax"), F.col("ty").alias("ay"))
    right = ends.select(F.col("line_id").alias("b"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"), F.col("tx").alias("bx"), F.col("ty").alias("by"))
    near = within_distance(left, right, hole_m[1]).filter((F.col("a") < F.col("b")) & (F.col("m") >= hole_m[0]))
    vx, vy = geo.local_unit("lon", "lat", "r_lon", "r_lat")
    facing = (geo.cosine_2d("ax", "ay", "bx", "by") <= -0.9) & (-(vx * F.col("ax") + vy * F.col("ay")) >= 0.9)
    return near.filter(facing).select("a", "b", F.col("lon").alias("x"), F.col("lat").alias("y"), F.floor(F.col("m") + 0.5).cast("long").alias("gap"))


def line_quality(lines: DataFrame, box: Column, most_components: int = 40, most_holes: int = 8) -> DataFrame:
    """One row (components, lines, holes, ok): whether stitched lines hang together."""
    holes = interior_holes(lines, box).agg(F.count(F.lit(1)).alias("holes"))
    both = continuity(lines).join(F.broadcast(holes), F.lit(True))  # one row each
    return both.withColumn("ok", (F.col("components") <= most_components) & (F.col("holes") <= most_holes))


def resolve_source(request: DataFrame, *tables: DataFrame, key: str = "relation_id") -> DataFrame:
    """Each requested key with the first table that has it: bundled, cached, stored, pack, captured, in the given order."""
    every = None
    for k, t in enumerate(tables):
        x = t.select(key, F.lit(k).alias("priority"), F.struct(*[c for c in t.columns if c != key]).alias("value"))
        every = x if every is None else every.union(x)
    best = every.groupBy(key).agg(F.min_by("value", "priority").alias("value"), F.min("priority").alias("priority"))
    return request.join(best, key, "left")
