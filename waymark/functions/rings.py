"""Rings, lines and polygons as arrays of structs, measured by higher-order functions.

A line or ring is array<struct<x,y>>, a polygon an array of rings (outer first), a multipolygon an array of polygons. Every
function takes an array *column*, not an expression that builds one: lambdas read it once an entry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.geo import AREA_M, DEGREE_M, SHARE_EPS, _haversine, EARTH_M, c, crossing_shares


def _pairs(line: Column, f) -> Column:
    """f over consecutive points, added up."""
    n = F.size(line)
    steps = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + f(F.get(line, i), F.get(line, i + 1)))


def length_m(line: Column) -> Column:
    """Metres along a line."""
    return _pairs(line, lambda a, b: _haversine(a["x"], a["y"], b["x"], b["y"], EARTH_M))


def planar_area(ring: Column) -> Column:
    """The shoelace area of a closed ring, in square units; positive if counter-clockwise."""
    return _pairs(ring, lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]) / 2)


def sphere_area_m2(ring: Column) -> Column:
    """Signed area on the sphere; positive if clockwise."""
    return _pairs(ring, lambda a, b: F.radians(b["x"] - a["x"]) * (2 + F.sin(F.radians(a["y"])) + F.sin(F.radians(b["y"])))) * (AREA_M * AREA_M / 2)


def equirect_area_m2(ring: Column) -> Column:
    """Planar metres at the ring's mean latitude; 0 for fewer than 4 points."""
    mean = F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p["y"]) / F.nullif(F.size(ring), F.lit(0))
    return F.when(F.size(ring) < 4, 0.0).otherwise(F.abs(planar_area(ring)) * DEGREE_M * DEGREE_M * F.cos(F.radians(mean)))


def _outer_less_holes(polygon: Column, of) -> Column:
    every = F.transform(polygon, lambda r: F.abs(of(r)))
    return F.greatest(F.lit(0.0), 2 * F.coalesce(F.get(every, F.lit(0)), F.lit(0.0)) - F.aggregate(every, F.lit(0.0), lambda acc, v: acc + v))


def polygon_area_m2(polygon: Column) -> Column:
    """Spherical area of the outer ring less its holes."""
    return _outer_less_holes(polygon, sphere_area_m2)


def polygon_planar_area(polygon: Column) -> Column:
    return _outer_less_holes(polygon, planar_area)


def multipolygon_area_m2(multi: Column) -> Column:
    return F.aggregate(F.transform(multi, polygon_area_m2), F.lit(0.0), lambda acc, v: acc + v)


def polygon_perimeter_m(polygon: Column) -> Column:
    return F.aggregate(F.transform(polygon, length_m), F.lit(0.0), lambda acc, v: acc + v)


def bounds(line: Column) -> Column:
    """The box of an array of points, as a struct (w, s, e, n)."""
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("w"), F.array_min(ys).alias("s"), F.array_max(xs).alias("e"), F.array_max(ys).alias("n"))


def box_centre_point(line: Column) -> Column:
    b = bounds(line)
    return F.struct(((b["w"] + b["e"]) / 2).alias("x"), ((b["s"] + b["n"]) / 2).alias("y"))


def has_valid_rings(polygon: Column) -> Column:
    return F.forall(polygon, lambda r: F.size(r) >= 3)


def count_points(multi: Column) -> Column:
    """Coordinate pairs of a multipolygon."""
    return F.aggregate(F.flatten(multi), F.lit(0), lambda acc, r: acc + F.size(r))


def largest_ring(multi: Column) -> Column:
    return F.array_max(F.transform(F.flatten(multi), F.size))


def valid_point(p: Column) -> Column:
    ok = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return ok(p["x"]) & ok(p["y"])


def sanity(multi: Column) -> Column:
    """Counts of points, of points that are not finite, of rings, of rings that don't close, and the first bad point."""
    points = F.flatten(F.flatten(multi))
    bad = F.filter(points, lambda p: ~valid_point(p))
    rings = F.flatten(multi)
    unclosed = F.filter(rings, lambda r: (F.size(r) == 0) | (F.get(r, F.lit(0)) != F.element_at(r, -1)))
    return F.struct(F.size(points).alias("points"), F.size(bad).alias("not_finite"), F.size(rings).alias("rings"), F.size(unclosed).alias("unclosed"), F.get(bad, F.lit(0)).alias("first_bad"))


def drop_repeats(line: Column) -> Column:
    """A line without consecutive equal points."""
    return F.filter(line, lambda p, i: (i == 0) | (p != F.get(line, i - 1)))


def count_repeats(line: Column) -> Column:
    return F.size(line) - F.size(drop_repeats(line))


def clean_polygon(polygon: Column, least: int = 4) -> Column:
    """Rings without repeated points; rings left with fewer than ``least`` points go; null if none is left."""
    rings = F.filter(F.transform(polygon, drop_repeats), lambda r: F.size(r) >= least)
    return F.when(F.size(rings) > 0, rings)


def subsample(line: Column, target: int) -> Column:
    """``target`` points evenly spread over the line, both ends included; shorter lines as they are."""
    step = (F.size(line) - 1) / F.lit(float(target - 1))
    some = F.transform(F.sequence(F.lit(0), F.lit(target - 1)), lambda k: F.get(line, F.floor(k * step + 0.5).cast("int")))
    return F.when(F.size(line) <= target, line).otherwise(some)


def point_in_ring(x, y, ring: Column) -> Column:
    """Even-odd rule; edges are half-open in y."""
    n = F.size(ring)
    steps = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        at = (b["x"] - a["x"]) * (c(y) - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return F.when(((a["y"] > c(y)) != (b["y"] > c(y))) & (c(x) < at), 1).otherwise(0)

    return F.aggregate(steps, F.lit(0), lambda acc, i: acc + crosses(i)) % 2 == 1


def point_in_polygon(x, y, polygon: Column) -> Column:
    """In the outer ring and in no hole."""
    inside = F.transform(polygon, lambda r: point_in_ring(x, y, r))
    return F.coalesce(F.get(inside, F.lit(0)), F.lit(False)) & ~F.exists(F.slice(inside, 2, F.size(inside)), lambda v: v)


def point_in_multipolygon(x, y, multi: Column) -> Column:
    return F.exists(multi, lambda p: point_in_polygon(x, y, p))


def point_in_geometry(x, y, kind: Column, multi: Column) -> Column:
    """False for anything but polygons."""
    return F.when(kind.isin("Polygon", "MultiPolygon"), point_in_multipolygon(x, y, multi)).otherwise(False)


def members_in_box(multi: Column, box: Column) -> Column:
    """Polygons whose bounds meet a box; the others go."""

    def meets(p: Column) -> Column:
        b = bounds(F.get(p, F.lit(0)))
        return (b["w"] <= box["e"]) & (b["e"] >= box["w"]) & (b["s"] <= box["n"]) & (b["n"] >= box["s"])

    return F.filter(multi, meets)


def crossings(ax, ay, bx, by, multi: Column) -> Column:
    """Where along a-b (0 to 1) it crosses the rings' edges, in no order; null for edges that it doesn't cross.

    An edge's ends belong to it, so a line through a corner crosses there; a's and b's own places are no crossings.
    """

    def where(*ends) -> Column:
        t, u = crossing_shares(*ends)
        return F.when((t > SHARE_EPS) & (t < 1 - SHARE_EPS) & (u >= -SHARE_EPS) & (u <= 1 + SHARE_EPS), t)

    def edges(r: Column) -> Column:
        steps = F.when(F.size(r) > 1, F.sequence(F.lit(0), F.size(r) - 2)).otherwise(F.array().cast("array<int>"))
        return F.transform(steps, lambda i: where(c(ax), c(ay), c(bx), c(by), F.get(r, i)["x"], F.get(r, i)["y"], F.get(r, i + 1)["x"], F.get(r, i + 1)["y"]))

    return F.flatten(F.transform(F.flatten(multi), edges))


def drop_tiny(multi: Column, least_m2: float) -> Column:
    """kept (polygons of ``least_m2`` or more) and dropped (how many went)."""
    kept = F.filter(multi, lambda p: polygon_area_m2(p) >= least_m2)
    return F.struct(kept.alias("kept"), (F.size(multi) - F.size(kept)).alias("dropped"))


# --- codecs on integer grids


def delta_ring(ring: Column, scale: float = 1e5) -> Column:
    """[number of points, x0, y0, dx, dy, ...] on an integer grid; rings of fewer than 3 points raise an error."""
    q = lambda v: F.floor(v * scale + 0.5).cast("int")

    def pair(p: Column, i: Column) -> Column:
        before = F.get(ring, i - 1)
        return F.when(i == 0, F.array(q(p["x"]), q(p["y"]))).otherwise(F.array(q(p["x"]) - q(before["x"]), q(p["y"]) - q(before["y"])))

    ok = F.when(F.size(ring) >= 3, F.size(ring)).otherwise(F.raise_error(F.lit("a ring has fewer than 3 points")).cast("int"))
    return F.concat(F.array(ok), F.flatten(F.transform(ring, pair)))


def delta_encode(multi: Column, scale: float = 1e5) -> Column:
    """[polygons, (rings, (ring)...)...], all as one array of integers."""
    polygon = lambda p: F.concat(F.array(F.size(p)), F.flatten(F.transform(p, lambda r: delta_ring(r, scale))))
    return F.concat(F.array(F.size(multi)), F.flatten(F.transform(multi, polygon)))


def delta_points(deltas: Column, scale: float = 1e5) -> Column:
    """x0, y0, dx, dy, ... back to points: running sums."""
    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.array().cast("array<struct<x:double,y:double>>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        x, y = acc["x"] + F.get(deltas, 2 * i), acc["y"] + F.get(deltas, 2 * i + 1)
        return F.struct(x.alias("x"), y.alias("y"), F.concat(acc["out"], F.array(F.struct((x / scale).alias("x"), (y / scale).alias("y")))).alias("out"))

    n = (F.size(deltas) / 2).cast("int")
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda acc: acc["out"])).otherwise(F.array().cast("array<struct<x:double,y:double>>"))


def compact_line(line: Column, scale: float = 1e6) -> Column:
    """[x0, y0, number of points, dx, dy, ...] on a finer grid; an empty array for an empty line."""
    q = lambda v: F.floor(v * scale + 0.5).cast("long")
    first = F.get(line, F.lit(0))
    rest = F.transform(F.slice(line, 2, F.size(line)), lambda p, i: F.array(q(p["x"]) - q(F.get(line, i)["x"]), q(p["y"]) - q(F.get(line, i)["y"])))
    head = F.array(q(first["x"]), q(first["y"]), F.size(line).cast("long"))
    return F.when(F.size(line) > 0, F.concat(head, F.flatten(rest))).otherwise(F.array().cast("array<long>"))


def expand_line(compact: Column, scale: float = 1e6) -> Column:
    """The points of a compact line."""
    deltas = F.concat(F.slice(compact, 1, 2), F.slice(compact, 4, F.size(compact)))
    return F.when(F.size(compact) > 2, delta_points(deltas, scale)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))


def mask_holes(multi: Column) -> Column:
    """A world ring with the outer ring of each polygon as a hole; holes of the polygons are ignored."""
    point = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    world = F.array(*(point(float(x), float(y)) for x, y in ((-180, -90), (180, -90), (180, 90), (-180, 90), (-180, -90))))
    outer = F.transform(multi, lambda p: F.get(p, F.lit(0)))
    clockwise = F.transform(outer, lambda r: F.when(planar_area(r) > 0, F.reverse(r)).otherwise(r))
    return F.concat(F.array(world), clockwise)
