"""Geodesy, boxes, units and number formats as Column expressions. Longitude comes first everywhere.

All of it stays inside generated JVM code: no Python runs per row. Boxes are structs (w, s, e, n); antimeridian and poles
are not handled by box logic, as documented on each function that uses one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The radii in metres (distances, destination points, areas), the pipelines' in kilometres, and scales.
EARTH_M, OFFSET_M, AREA_M, PIPELINE_KM = 6371008.8, 6371000.0, 6378137.0, 6371.0
DEGREE_M, MILE_M = 111320.0, 1609.344
#: How near to a segment's end, as a share of it, a crossing counts as at the end: far above rounding, far below any map's grid.
SHARE_EPS = 1e-9

Num = Column | str | float | int


def c(x: Num) -> Column:
    """A column by name, a column, or a number as a literal."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def js_round(x: Num) -> Column:
    """Nearest integer, halves upwards (also below zero), as a double."""
    return F.floor(c(x) + 0.5).cast("double")


def bbox(w: Num, s: Num, e: Num, n: Num) -> Column:
    return F.struct(c(w).alias("w"), c(s).alias("s"), c(e).alias("e"), c(n).alias("n"))


def _haversine(lon1: Num, lat1: Num, lon2: Num, lat2: Num, radius: float) -> Column:
    p1, p2 = F.radians(c(lat1)), F.radians(c(lat2))
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(c(lon2) - c(lon1)) / 2), 2)
    a = F.when(a > 1, 1.0).otherwise(a)  # not least(): that skips nulls
    return F.lit(2 * radius) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_m(lon1: Num, lat1: Num, lon2: Num, lat2: Num) -> Column:
    """Great-circle metres."""
    return _haversine(lon1, lat1, lon2, lat2, EARTH_M)


def haversine_km(lon1: Num, lat1: Num, lon2: Num, lat2: Num) -> Column:
    """Great-circle kilometres on the pipelines' sphere."""
    return _haversine(lon1, lat1, lon2, lat2, PIPELINE_KM)


def destination(lon: Num, lat: Num, bearing: Num, metres: Num) -> tuple[Column, Column]:
    """(lon, lat) reached from a point along a bearing in degrees."""
    d, b, p = c(metres) / OFFSET_M, F.radians(c(bearing)), F.radians(c(lat))
    lat2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    lon2 = F.radians(c(lon)) + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(lat2))
    return F.degrees(lon2), F.degrees(lat2)


def format_coordinate(lon: Num, lat: Num) -> Column:
    return F.format_string("(%.5f, %.5f)", c(lat), c(lon))


def node_key(lon: Num, lat: Num) -> Column:
    """A coordinate as text with 7 decimals, by which line ends are matched."""
    return F.format_string("%.7f,%.7f", c(lon), c(lat))


def quantize(deg: Num, scale: float = 1e5) -> Column:
    """Degrees on an integer grid."""
    return F.floor(c(deg) * scale + 0.5).cast("int")


# --- degrees and metres


def lat_degrees(metres: Num) -> Column:
    return c(metres) / DEGREE_M


def lon_degrees(metres: Num, lat: Num) -> Column:
    return c(metres) / (DEGREE_M * F.cos(F.radians(c(lat))))


# --- boxes


def boxes_meet(a: Column, b: Column) -> Column:
    """Rectangles overlap or touch."""
    return (a["w"] <= b["e"]) & (a["e"] >= b["w"]) & (a["s"] <= b["n"]) & (a["n"] >= b["s"])


def box_has_point(b: Column, lon: Num, lat: Num) -> Column:
    return c(lon).between(b["w"], b["e"]) & c(lat).between(b["s"], b["n"])


def box_has_box(outer: Column, inner: Column) -> Column:
    return (outer["w"] <= inner["w"]) & (outer["s"] <= inner["s"]) & (outer["e"] >= inner["e"]) & (outer["n"] >= inner["n"])


def pad_box(b: Column, degrees: Num) -> Column:
    return bbox(b["w"] - c(degrees), b["s"] - c(degrees), b["e"] + c(degrees), b["n"] + c(degrees))


def window_box(b: Column, metres: Num) -> Column:
    """A box padded by metres; the longitude pad is scaled at the middle latitude."""
    mid = (b["s"] + b["n"]) / 2
    dx, dy = lon_degrees(metres, mid), lat_degrees(metres)
    return bbox(b["w"] - dx, b["s"] - dy, b["e"] + dx, b["n"] + dy)


def circle_box(lon: Num, lat: Num, metres: Num) -> Column:
    """A box around a circle, with a margin of 1 %; all longitudes where the circle reaches a pole."""
    d = c(metres) / EARTH_M * 1.01
    dy = F.degrees(d)
    ratio = F.sin(d) / F.cos(F.radians(c(lat)))
    pole = (F.abs(c(lat)) + dy >= 90) | (F.abs(ratio) >= 1)
    dx = F.degrees(F.asin(F.when(pole, 0.0).otherwise(ratio)))
    return bbox(
        F.when(pole, -180.0).otherwise(c(lon) - dx), F.greatest(F.lit(-90.0), c(lat) - dy), F.when(pole, 180.0).otherwise(c(lon) + dx), F.least(F.lit(90.0), c(lat) + dy)
    )


def box_area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["e"] - b["w"]) * F.greatest(F.lit(0.0), b["n"] - b["s"])


def overlap_ratio(outer: Column, inner: Column) -> Column:
    """The part of ``inner`` that lies in ``outer``; 0 for an empty box."""
    both = bbox(F.greatest(outer["w"], inner["w"]), F.greatest(outer["s"], inner["s"]), F.least(outer["e"], inner["e"]), F.least(outer["n"], inner["n"]))
    return F.when(box_area(inner) > 0, box_area(both) / box_area(inner)).otherwise(0.0)


def box_centre(b: Column) -> tuple[Column, Column]:
    return (b["w"] + b["e"]) / 2, (b["s"] + b["n"]) / 2


def box_diagonal_m(b: Column) -> Column:
    """Planar diagonal in metres at the middle latitude."""
    mid = F.radians((b["s"] + b["n"]) / 2)
    return F.hypot((b["e"] - b["w"]) * DEGREE_M * F.cos(mid), (b["n"] - b["s"]) * DEGREE_M)


def box_edge_delta_m(a: Column, b: Column) -> Column:
    """The largest displacement of an edge, in metres."""
    mid = F.radians((a["s"] + a["n"]) / 2)
    dx = F.greatest(F.abs(a["w"] - b["w"]), F.abs(a["e"] - b["e"])) * DEGREE_M * F.cos(mid)
    return F.greatest(dx, F.greatest(F.abs(a["s"] - b["s"]), F.abs(a["n"] - b["n"])) * DEGREE_M)


def box_delta(a: Column, b: Column) -> Column:
    """The largest displacement of an edge, in the boxes' own unit."""
    return F.greatest(*(F.abs(a[k] - b[k]) for k in "wsen"))


def box_tolerance_m(radius: Num) -> Column:
    return c(radius) * 0.02 + 5


def circle_covers_box(lon: Num, lat: Num, metres: Num, b: Column) -> Column:
    """All four corners lie within the radius."""
    far = F.greatest(*(haversine_m(lon, lat, b[x], b[y]) for x in "we" for y in "sn"))
    return far <= c(metres)


def circle_covers_circle(lon1: Num, lat1: Num, r1: Num, lon2: Num, lat2: Num, r2: Num) -> Column:
    """The first circle holds the second."""
    return haversine_m(lon1, lat1, lon2, lat2) + c(r2) <= c(r1)


#: Boxes (west, south, east, north) that stand for the United States and Japan.
UNITED_STATES = (
    (-125.0, 24.4, -95.0, 49.0), (-95.0, 24.4, -83.0, 48.5), (-83.0, 24.4, -76.0, 43.3), (-76.0, 24.4, -71.0, 45.0), (-71.0, 24.4, -66.9, 47.5),
    (-170.0, 51.0, -129.9, 71.6), (-160.3, 18.9, -154.7, 22.3), (-67.3, 17.9, -65.2, 18.6),
)
JAPAN = (
    (138.4, 34.8, 140.3, 36.9), (136.5, 34.5, 138.8, 37.6), (134.6, 33.8, 136.9, 35.8), (130.7, 33.9, 134.6, 35.7),
    (131.9, 32.5, 134.8, 34.5), (128.6, 30.1, 132.4, 34.2), (139.4, 36.5, 142.2, 41.6), (139.0, 40.9, 145.8, 45.6),
)


def in_any_box(lon: Num, lat: Num, boxes: Sequence[tuple[float, float, float, float]]) -> Column:
    out = F.lit(False)
    for w, s, e, n in boxes:
        out = out | (c(lon).between(w, e) & c(lat).between(s, n))
    return out


def meets_any_box(b: Column, boxes: Sequence[tuple[float, float, float, float]]) -> Column:
    out = F.lit(False)
    for x in boxes:
        out = out | boxes_meet(b, bbox(*(float(v) for v in x)))
    return out


def default_units(lon: Num, lat: Num) -> Column:
    return F.when(in_any_box(lon, lat, UNITED_STATES), "imperial").otherwise("metric")


# --- units


def to_metres(text: Num, unit: Num) -> Column:
    """A positive, finite number in m, km or mi as metres; else null."""
    n = c(text).try_cast("double")
    scale = F.when(c(unit) == "m", 1.0).when(c(unit) == "km", 1000.0).when(c(unit) == "mi", MILE_M)
    return F.when((n > 0) & ~F.isnan(n) & (n < float("inf")), n * scale)


def format_distance(value: Num, decimals: int | None = None) -> Column:
    """An integer if within a millionth of one; else ``decimals``, or one from 10 on and two below."""
    v = c(value).cast("double")
    whole = F.abs(v - js_round(v)) < 1e-6
    text = F.format_string(f"%.{decimals}f", v) if decimals is not None else F.when(v >= 10, F.format_string("%.1f", v)).otherwise(F.format_string("%.2f", v))
    return F.when(whole, F.format_string("%d", js_round(v).cast("long"))).otherwise(text)


def from_metres(metres: Num, unit: Num) -> Column:
    scale = F.when(c(unit) == "km", 1000.0).when(c(unit) == "mi", MILE_M).otherwise(1.0)
    return format_distance(c(metres) / scale)


def format_station_distance(metres: Num) -> Column:
    m = c(metres)
    return F.when(m < 1000, F.format_string("%d meters", js_round(m).cast("long"))).otherwise(F.format_string("%.1f km", m / 1000))


# --- planar pieces in local metres


def local_metres(lon: Num, lat: Num, lon0: Num, lat0: Num) -> tuple[Column, Column]:
    """Offsets from a reference point, with the east offset scaled at its latitude."""
    return (c(lon) - c(lon0)) * DEGREE_M * F.cos(F.radians(c(lat0))), (c(lat) - c(lat0)) * DEGREE_M


def segment_fraction(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where on the segment, 0 to 1, the nearest point to p lies; 0 on a segment without length."""
    dx, dy = bx - ax, by - ay
    t = ((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))


def point_segment_m(lon: Num, lat: Num, alon: Num, alat: Num, blon: Num, blat: Num) -> Column:
    """Planar metres from a point to a segment, scaled at the point's latitude."""
    ax, ay = local_metres(alon, alat, lon, lat)
    bx, by = local_metres(blon, blat, lon, lat)
    zero = F.lit(0.0)
    t = segment_fraction(zero, zero, ax, ay, bx, by)
    return F.hypot(ax + t * (bx - ax), ay + t * (by - ay))


def point_segment_haversine_m(lon: Num, lat: Num, alon: Num, alat: Num, blon: Num, blat: Num) -> Column:
    """Great-circle metres (pipelines' sphere) to the planar nearest point of a segment."""
    k = F.cos(F.radians(c(lat)))
    t = segment_fraction(c(lon) * k, c(lat), c(alon) * k, c(alat), c(blon) * k, c(blat))
    return _haversine(lon, lat, c(alon) + t * (c(blon) - c(alon)), c(alat) + t * (c(blat) - c(alat)), 6371000.0)


def segment_crossing(ax: Num, ay: Num, bx: Num, by: Num, cx: Num, cy: Num, dx: Num, dy: Num) -> Column:
    """Where on a-b it crosses c-d, inside both; null if it doesn't.

    What lies within ``SHARE_EPS`` of an end counts as at the end and is no crossing, so that rounding decides nothing.
    """
    t, u = crossing_shares(ax, ay, bx, by, cx, cy, dx, dy)
    inside = lambda v: (v > SHARE_EPS) & (v < 1 - SHARE_EPS)
    return F.when(inside(t) & inside(u), t)


def crossing_shares(ax: Num, ay: Num, bx: Num, by: Num, cx: Num, cy: Num, dx: Num, dy: Num) -> tuple[Column, Column]:
    """Where on a-b and where on c-d their lines cross, as shares of the segments; null if they are parallel."""
    ax, ay, bx, by, cx, cy, dx, dy = map(c, (ax, ay, bx, by, cx, cy, dx, dy))
    den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / F.nullif(den, F.lit(0.0))
    u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / F.nullif(den, F.lit(0.0))
    return t, u


def cosine_2d(ax: Num, ay: Num, bx: Num, by: Num) -> Column:
    """Of unit vectors."""
    return c(ax) * c(bx) + c(ay) * c(by)


def local_unit(lon1: Num, lat1: Num, lon2: Num, lat2: Num) -> tuple[Column, Column]:
    """The direction between two points as a unit vector in local metres; (0, 0) if they coincide."""
    x, y = local_metres(lon2, lat2, lon1, (c(lat1) + c(lat2)) / 2)
    y = (c(lat2) - c(lat1)) * DEGREE_M
    n = F.hypot(x, y)
    return F.when(n > 0, x / n).otherwise(0.0), F.when(n > 0, y / n).otherwise(0.0)


def clip_segment(ax: Num, ay: Num, bx: Num, by: Num, b: Column) -> tuple[Column, Column]:
    """The part of a segment inside a box as fractions (enter, leave); null if nothing is inside."""
    ax, ay, bx, by = map(c, (ax, ay, bx, by))
    lo, hi, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
    for p, q in ((ax - bx, ax - b["w"]), (bx - ax, b["e"] - ax), (ay - by, ay - b["s"]), (by - ay, b["n"] - ay)):
        r = q / F.nullif(p, F.lit(0.0))
        ok = ok & ((p != 0) | (q >= 0))
        lo = F.when(p < 0, F.greatest(lo, r)).otherwise(lo)
        hi = F.when(p > 0, F.least(hi, r)).otherwise(hi)
    ok = ok & (lo <= hi)
    return F.when(ok, lo), F.when(ok, hi)


def _unit(v: Column) -> Column:
    """v kept within -1..1; null stays null."""
    return F.when(v > 1, 1.0).when(v < -1, -1.0).otherwise(v)


def aeqd(lon: Num, lat: Num, lon0: Num, lat0: Num) -> tuple[Column, Column]:
    """Azimuthal equidistant metres around a centre."""
    p, p0, dl = F.radians(c(lat)), F.radians(c(lat0)), F.radians(c(lon) - c(lon0))
    cos_c = _unit(F.sin(p0) * F.sin(p) + F.cos(p0) * F.cos(p) * F.cos(dl))
    ang = F.acos(cos_c)
    k = F.when(ang < 1e-12, 1.0).otherwise(ang / F.sin(ang)) * EARTH_M
    return k * F.cos(p) * F.sin(dl), k * (F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(dl))


def aeqd_inverse(x: Num, y: Num, lon0: Num, lat0: Num) -> tuple[Column, Column]:
    x, y, p0 = c(x), c(y), F.radians(c(lat0))
    rho = F.hypot(x, y)
    ang = rho / EARTH_M
    near = rho < 1e-9
    lat = F.when(near, p0).otherwise(F.asin(_unit(F.cos(ang) * F.sin(p0) + y * F.sin(ang) * F.cos(p0) / F.nullif(rho, F.lit(0.0)))))
    lon = F.radians(c(lon0)) + F.when(near, 0.0).otherwise(F.atan2(x * F.sin(ang), rho * F.cos(p0) * F.cos(ang) - y * F.sin(p0) * F.sin(ang)))
    return F.degrees(lon), F.degrees(lat)


def toward_second(lon: Num, lat: Num, lon1: Num, lat1: Num, lon2: Num, lat2: Num) -> Column:
    """Signed: positive on the second point's side of the perpendicular bisector, in local metres around the middle."""
    mlon, mlat = (c(lon1) + c(lon2)) / 2, (c(lat1) + c(lat2)) / 2
    x, y = local_metres(lon, lat, mlon, mlat)
    dx, dy = local_metres(lon2, lat2, mlon, mlat)
    return x * dx + y * dy


def circle_ring(lon: Num, lat: Num, metres: Num, corners: int) -> Column:
    """A closed ring of ``corners`` points at a distance, clockwise from the top, as array<struct<x,y>>."""

    def at(k: Column) -> Column:
        x, y = destination(lon, lat, k * (-360.0 / corners), metres)
        return F.struct(x.alias("x"), y.alias("y"))

    ring = F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), at)
    return F.concat(ring, F.slice(ring, 1, 1))
