"""Geometry that needs order or construction, as numpy on Arrow batches: one geometry a row, nothing larger in a task.

Lines and rings are array<struct<x,y>>, polygons arrays of rings, multipolygons arrays of polygons, as in ``rings``.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
LINE = T.ArrayType(POINT)
POLYGON = T.ArrayType(LINE)
MULTI = T.ArrayType(POLYGON)
DEGREE_M, EARTH_M = 111320.0, 6371008.8
TIE = 1e-9


def _xy(line) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in line], float).reshape(-1, 2)


def _line(xy) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in xy]


# --- simplification


def simplify_xy(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Points that a polyline needs to stay within a tolerance (greater than) of the original; both ends stay.

    Of the farthest points the first stays; distances that differ by less than TIE of themselves are equal, so that rounding
    decides nothing.
    A stack of index ranges replaces recursion, so long lines are no problem.
    """
    n = len(xy)
    if n < 3:
        return np.arange(n)
    keep = np.zeros(n, bool)
    keep[[0, -1]] = True
    work = [(0, n - 1)]
    while work:
        a, b = work.pop()
        if b - a < 2:
            continue
        p, q, mid = xy[a], xy[b], xy[a + 1 : b]
        d = q - p
        len2 = float(d @ d)
        t = np.clip(((mid - p) @ d) / len2, 0, 1) if len2 else np.zeros(len(mid))
        far = np.hypot(*(mid - p - t[:, None] * d).T)
        most = far.max()
        if most > tolerance * (1 + TIE):
            k = int((far >= most * (1 - TIE)).argmax()) + a + 1
            keep[k] = True
            work += [(a, k), (k, b)]
    return np.flatnonzero(keep)


def simplify_line(line, tolerance_m: float | None = None, degrees: float | None = None):
    """A line simplified in local metres, or in degrees. Lines of fewer than 3 points stay; null stays null."""
    if line is None or len(line) < 3:
        return line
    xy = _xy(line)
    if degrees is not None:
        return _line(xy[simplify_xy(xy, degrees)])
    k = math.cos(math.radians(float(xy[:, 1].mean())))
    return _line(xy[simplify_xy(xy * [DEGREE_M * k, DEGREE_M], tolerance_m or 0.0)])


def simplify_m(tolerance_m: float):
    """Column function: lines simplified to a tolerance in metres."""
    return _udf(lambda v: simplify_line(v, tolerance_m=tolerance_m), LINE)


def simplify_deg(tolerance: float):
    """Column function: lines simplified to a tolerance in degrees."""
    return _udf(lambda v: simplify_line(v, degrees=tolerance), LINE)


def simplify_polygon(tolerance: float, least: int = 4):
    """Column function: each ring simplified in degrees; a ring that falls below ``least`` points is retried at a quarter of
    the tolerance, and then left as it was."""

    def ring(r):
        for t in (tolerance, tolerance / 4):
            out = simplify_line(r, degrees=t)
            if len(out) >= least:
                return out
        return r

    return _udf(lambda p: None if p is None else [ring(r) for r in p], POLYGON)


def _udf(f, kind):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else f(v))

    return F.pandas_udf(run, kind)


# --- clipping


def clip_convex_xy(subject: np.ndarray, convex: np.ndarray) -> np.ndarray:
    """An open ring cut to a convex, counter-clockwise open ring: one half-plane after the other."""
    out = subject
    for a, b in zip(convex, np.roll(convex, -1, axis=0), strict=True):
        if not len(out):
            break
        d = b - a
        side = d[0] * (out[:, 1] - a[1]) - d[1] * (out[:, 0] - a[0])
        nxt, side2 = np.roll(out, -1, axis=0), np.roll(side, -1)
        points = []
        for p, q, s, s2 in zip(out, nxt, side, side2, strict=True):
            if s >= 0:
                points.append(p)
            if (s > 0 > s2) or (s < 0 < s2):
                points.append(p + (q - p) * (s / (s - s2)))
        out = np.array(points).reshape(-1, 2)
    return out


def _area(xy: np.ndarray) -> float:
    x, y = xy.T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _open(xy: np.ndarray) -> np.ndarray:
    return xy[:-1] if len(xy) > 1 and (xy[0] == xy[-1]).all() else xy


def _closed(xy: np.ndarray) -> list[dict]:
    return _line([*xy, xy[0]]) if len(xy) >= 3 else []


@F.pandas_udf(LINE)
def clip_to_convex(rings: pd.Series, windows: pd.Series) -> pd.Series:
    """A ring cut to a convex ring of any orientation; an empty line if nothing is left."""

    def one(ring, window):
        if ring is None or window is None:
            return None
        w = _open(_xy(window))
        w = w if _area(w) > 0 else w[::-1]
        return _closed(clip_convex_xy(_open(_xy(ring)), w))

    return pd.Series([one(r, w) for r, w in zip(rings, windows, strict=True)], dtype=object)


def voronoi(points: list[tuple], box: tuple[float, float, float, float]) -> list[list[dict]]:
    """Each point's cell in the plane, cut to a box: half-planes towards all others, nearest first, until none can reach it.

    Blocks of points take their next half-plane together; a block's distances fill at most 32 MB, or one point's.
    """
    xy = np.array(points, float).reshape(-1, 2)
    block = max(1, 4_000_000 // max(1, len(xy)))
    return [_closed(cell) for at in range(0, len(xy), block) for cell in _voronoi_block(xy, xy[at : at + block], box)]


def _voronoi_block(xy: np.ndarray, own: np.ndarray, box: tuple[float, float, float, float]) -> list[np.ndarray]:
    w, s, e, n = box
    cell, size = np.repeat(np.array([[(w, s), (e, s), (e, n), (w, n)]], float), len(own), axis=0), np.full(len(own), 4)
    d = np.hypot(xy[:, 0] - own[:, :1], xy[:, 1] - own[:, 1:])
    order, live = np.argsort(d, axis=1, kind="stable"), np.arange(len(own))
    for rank in range(len(xy)):
        other = order[live, rank]
        inside = np.arange(cell.shape[1]) < size[live, None]
        far = np.where(inside, np.hypot(*np.moveaxis(cell[live] - own[live, None], 2, 0)), -1.0).max(1)
        open_ = d[live, other] / 2 <= far
        live, other = live[open_], other[open_]
        if not len(live):
            break
        cut, other = live[d[live, other] > 0], other[d[live, other] > 0]  # equal places don't cut each other
        if not len(cut):
            continue
        new, count = _cut(cell[cut], size[cut], (xy[other] + own[cut]) / 2, own[cut] - xy[other])
        if new.shape[1] > cell.shape[1]:
            cell = np.pad(cell, ((0, 0), (0, new.shape[1] - cell.shape[1]), (0, 0)))
        cell[cut, : new.shape[1]], size[cut] = new, count
    return [c[:k] for c, k in zip(cell, size, strict=True)]


def _cut(cell: np.ndarray, size: np.ndarray, mid: np.ndarray, normal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Convex cells (row by row, ``size`` corners each) cut by a half-plane each: corners, and how many."""
    corner = np.arange(cell.shape[1])
    inside, following = corner < size[:, None], np.where(corner + 1 < size[:, None], corner + 1, 0)
    side = ((cell - mid[:, None]) * normal[:, None]).sum(2)
    side2, cell2 = np.take_along_axis(side, following, 1), np.take_along_axis(cell, following[..., None], 1)
    crosses = inside & (((side > 0) & (side2 < 0)) | ((side < 0) & (side2 > 0)))
    share = np.divide(side, side - side2, out=np.zeros_like(side), where=crosses)
    points = np.stack([cell, cell + (cell2 - cell) * share[..., None]], axis=2).reshape(len(cell), -1, 2)
    kept = np.stack([inside & (side >= 0), crosses], axis=2).reshape(len(cell), -1)
    count = kept.sum(1)
    first = np.argsort(~kept, axis=1, kind="stable")[:, : max(1, count.max())]
    return np.take_along_axis(points, first[..., None], 1), count


# --- well-known binary


def wkb(kind: str, value) -> bytes:
    """Little-endian well-known binary of LineString, MultiLineString, Polygon or MultiPolygon."""
    line = lambda pts: struct.pack("<I", len(pts)) + b"".join(struct.pack("<dd", p["x"], p["y"]) for p in pts)
    rings = lambda rs: struct.pack("<I", len(rs)) + b"".join(line(r) for r in rs)
    head = lambda code: struct.pack("<BI", 1, code)
    if kind == "Point":
        return head(1) + struct.pack("<dd", value["x"], value["y"])
    if kind == "LineString":
        return head(2) + line(value)
    if kind == "Polygon":
        return head(3) + rings(value)
    if kind == "MultiLineString":
        return head(5) + struct.pack("<I", len(value)) + b"".join(wkb("LineString", v) for v in value)
    if kind == "MultiPolygon":
        return head(6) + struct.pack("<I", len(value)) + b"".join(wkb("Polygon", v) for v in value)
    raise ValueError(f"no binary form for {kind}")


def read_wkb(raw: bytes) -> list:
    """The polygons of a Polygon, MultiPolygon, or collection (other members are skipped), in either byte order.

    Truncated or odd input raises ValueError.
    """
    at = 0

    def take(fmt: str) -> tuple:
        nonlocal at
        size = struct.calcsize(fmt)
        if at + size > len(raw):
            raise ValueError("the binary form ends early")
        out = struct.unpack_from(fmt, raw, at)
        at += size
        return out

    def geometry() -> list:
        order = "<" if take("B")[0] == 1 else ">"
        code = take(order + "I")[0]
        base, dims = code % 1000, 2 + (code // 1000 in (1, 2)) + 2 * (code // 1000 == 3)

        def points() -> list:
            n = take(order + "I")[0]
            if n * 8 * dims > len(raw) - at:
                raise ValueError("the binary form ends early")
            return [dict(zip("xy", take(f"{order}{dims}d")[:2], strict=True)) for _ in range(n)]

        if base == 1:
            take(f"{order}{dims}d")
            return []
        if base == 2:
            points()
            return []
        if base == 3:
            return [[points() for _ in range(take(order + "I")[0])]]
        if base in (4, 5, 6, 7):
            return [p for _ in range(take(order + "I")[0]) for p in geometry()]
        raise ValueError(f"unknown kind {code}")

    return geometry()


@F.pandas_udf(T.BinaryType())
def multipolygon_wkb(multis: pd.Series) -> pd.Series:
    """One member gives a Polygon, others a MultiPolygon; null for null."""
    return multis.map(lambda m: None if m is None else wkb("Polygon", m[0]) if len(m) == 1 else wkb("MultiPolygon", m))


@F.pandas_udf(MULTI)
def wkb_multipolygon(raws: pd.Series) -> pd.Series:
    """Polygons from binary; malformed input gives null."""

    def one(raw):
        try:
            return None if raw is None else read_wkb(bytes(raw))
        except ValueError:
            return None

    return raws.map(one)


# --- deltas to polygons


def delta_decode(code, scale: float = 1e5) -> list:
    """[polygons, (rings, (points, x0, y0, dx, dy, ...)...)...] back to a multipolygon; empty input gives none."""
    if code is None or not len(code):
        return []
    values, at = list(map(int, code)), 1

    def take() -> int:
        nonlocal at
        at += 1
        return values[at - 1]

    out = []
    for _ in range(values[0]):
        polygon = []
        for _ in range(take()):
            n = take()
            if n < 3 or at + 2 * n > len(values):
                raise ValueError("a ring is too short")
            xy = np.array(values[at : at + 2 * n]).reshape(-1, 2).cumsum(axis=0) / scale
            at += 2 * n
            polygon.append(_line(xy))
        out.append(polygon)
    return out


decode_delta = _udf(delta_decode, MULTI)


# --- buffers in predicate form have no polygon; these give one for display


def buffer_line_xy(xy: np.ndarray, metres: float, steps: int = 8) -> list[np.ndarray]:
    """Convex capsules around each segment, in local metres: their union is the buffer."""
    turn = np.linspace(0, math.pi, 2 * steps + 1)
    out = []
    for a, b in zip(xy[:-1], xy[1:], strict=True):
        d = b - a
        if not d.any():
            continue
        ang = math.atan2(d[1], d[0])
        front = b + metres * np.column_stack([np.cos(ang - math.pi / 2 + turn), np.sin(ang - math.pi / 2 + turn)])
        back = a + metres * np.column_stack([np.cos(ang + math.pi / 2 + turn), np.sin(ang + math.pi / 2 + turn)])
        out.append(np.concatenate([front, back]))
    return out


def line_buffer(metres: float, steps: int = 8):
    """Column function: a line's buffer as a multipolygon of overlapping capsules, projected around the line's middle."""

    def one(line):
        xy = _xy(line)
        k = math.cos(math.radians(float(xy[:, 1].mean())))
        scale, mid = np.array([DEGREE_M * k, DEGREE_M]), xy.mean(axis=0)
        return [[_closed(c / scale + mid)] for c in buffer_line_xy((xy - mid) * scale, metres, steps)]

    return _udf(one, MULTI)
