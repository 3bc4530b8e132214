"""Algorithms whose result depends on order, one independent group at a time.

Each runs as a grouped Arrow function over the smallest key within which rows can affect each other: a neighbourhood of one
name for stations, the variant for stop order, ways that share ends for stitching, connected lines for parallel tracks and
gaps. Groups are therefore bounded by the data's own structure, not by the table or a frequent key.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict, deque
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.operators.graph import connected_components
from waymark.operators.transit import first_by
from waymark.session import save

DEGREE_M, EARTH_M = 111320.0, 6371000.0


def metres(lon1, lat1, lon2, lat2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(np.asarray(lon2) - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(0, 1 - a)))


def completeness(df: DataFrame) -> DataFrame:
    """Adds ``score``: English name 4, railway=station 3, operator 2, encyclopedia id 1."""
    has = lambda c, n: F.when(F.length(F.coalesce(F.col(c), F.lit(""))) > 0, n).otherwise(0)
    station = F.when(F.coalesce(F.try_element_at("tags", F.lit("railway")) == "station", F.lit(False)), 3).otherwise(0)
    return df.withColumn("score", has("name_en", 4) + station + has("operator", 2) + has("wikidata", 1))


def dedupe_stations(stations: DataFrame, near_m: float = 150.0) -> DataFrame:
    """Stations after three rounds: the first of each id; of each encyclopedia id the most complete, in the first one's place;
    of each name, stations within 150 m of one kept before go.

    Columns: id, name, name_en, normalised, wikidata, operator, tags, lon, lat, ord. Rows without an encyclopedia id or name
    skip that round.
    """
    s = completeness(first_by(stations, ["id"], F.col("ord")))
    tagged = s.filter("wikidata IS NOT NULL AND wikidata <> ''")
    cols = [c for c in s.columns if c not in ("wikidata", "ord")]
    best = tagged.groupBy("wikidata").agg(F.max_by(F.struct(*cols), F.struct("score", (-F.col("ord")).alias("o"))).alias("x"), F.min("ord").alias("ord"))
    s = s.filter("wikidata IS NULL OR wikidata = ''").unionByName(best.select("wikidata", "ord", "x.*"))
    placed = (F.col("normalised") != "") & F.col("lon").isNotNull() & F.col("lat").isNotNull()
    placed = F.coalesce(placed, F.lit(False))
    named = first_by(s.filter(placed), ["normalised", "lon", "lat"], F.col("ord"))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        kept: list[int] = []
        lon, lat = pdf["lon"].to_numpy(), pdf["lat"].to_numpy()
        for k in range(len(pdf)):
            if not kept or metres(lon[kept], lat[kept], lon[k], lat[k]).min() > near_m:
                kept.append(k)
        return pdf.iloc[kept][["id"]]

    near = neighbourhoods(named.select("id", "normalised", "lon", "lat", "ord"), "normalised", near_m)
    keep = near.groupBy("component").applyInPandas(greedy, named.select("id").schema)
    return s.filter(~placed).unionByName(named.join(keep, "id", "left_semi").select(*s.columns)).drop("score")


def neighbourhoods(points: DataFrame, key: str, near_m: float) -> DataFrame:
    """Adds ``component``: points of one key that lie within metres of each other, directly or through others, share it.

    Points fall into cubes of that size in space, and components are of neighbouring cubes with points, so no pairs of points
    are formed. Far points may share a component, near ones always do.
    """
    side = near_m * 1.001 / EARTH_M
    lon, lat = F.radians("lon"), F.radians("lat")
    at = [F.floor(v / side) for v in (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))]
    name = lambda x, y, z: F.concat_ws(" ", x, y, z, F.col(key).cast("string"))
    p = points.withColumns({"__x": at[0], "__y": at[1], "__z": at[2]}).withColumn("__cube", name("__x", "__y", "__z"))
    cubes = save(p.select("__x", "__y", "__z", key, F.col("__cube").alias("node")).distinct())
    steps = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) > (0, 0, 0)]
    beside = F.explode(F.array(*(name(F.col("__x") + x, F.col("__y") + y, F.col("__z") + z) for x, y, z in steps)))
    edges = cubes.select(F.col("node").alias("a"), beside.alias("b")).join(cubes.select(F.col("node").alias("b")), "b", "left_semi")
    parts = connected_components(cubes.select("node"), edges).select(F.col("node").alias("__cube"), "component")
    return p.join(parts, "__cube").select(*points.columns, "component")


def _gaps(xy: np.ndarray) -> tuple[np.ndarray, float]:
    """Gaps between consecutive stops, and the limit above which one is implausible."""
    g = metres(xy[:-1, 0], xy[:-1, 1], xy[1:, 0], xy[1:, 1])
    rest = np.delete(g, g.argmax()) if len(g) else g
    return g, max(20000.0, 4 * float(np.median(rest))) if len(rest) else 20000.0


def repair_order(xy: np.ndarray, most: int = 3) -> np.ndarray:
    """Positions of stops in repaired order: stops between implausible gaps move to where they lengthen the path least.

    At most ``most`` moves; if an implausible gap is still there at the end, the order stays as it was.
    """
    order = list(range(len(xy)))
    for _ in range(most):
        g, limit = _gaps(xy[order])
        bad = np.flatnonzero(g > limit)
        if not len(bad):
            break
        k = int(bad[0])
        out = k if k == 0 else k + 1
        moved = order.pop(out)
        pts = xy[order]
        costs = []
        for at in range(len(order) + 1):
            left = metres(*pts[at - 1], *xy[moved]) if at > 0 else 0.0
            right = metres(*pts[at], *xy[moved]) if at < len(order) else 0.0
            gone = metres(*pts[at - 1], *pts[at]) if 0 < at < len(order) else 0.0
            costs.append(float(left + right - gone))
        order.insert(int(np.argmin(costs)), moved)
    g, limit = _gaps(xy[order])
    return np.array(order) if not (g > limit).any() else np.arange(len(xy))


def repair_stops(stops: DataFrame) -> DataFrame:
    """(variant, seq, id, lon, lat) with seq renumbered from 0 in repaired order."""

    cols = stops.select("variant", F.col("seq").cast("int").alias("seq"), "id", "lon", "lat")
    s = cols.groupBy("variant").agg(F.array_sort(F.collect_list(F.struct("seq", "id", "lon", "lat"))).alias("s"))
    order = _repaired(F.transform("s", lambda p: p["lon"]), F.transform("s", lambda p: p["lat"]))
    stop = F.get("s", F.col("i"))
    return s.select("variant", "s", F.posexplode(order).alias("n", "i")).select("variant", F.col("n").alias("seq"), *(stop[c].alias(c) for c in ("id", "lon", "lat")))


def _gaps_of_all(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_gaps``, a row a line: lines of one length, at least 3."""
    g = metres(x[:, :-1], y[:, :-1], x[:, 1:], y[:, 1:])
    rest = np.where(np.arange(g.shape[1]) == g.argmax(1)[:, None], np.nan, g)
    rest = np.sort(rest, axis=1)[:, :-1]  # the widest, as NaN, last
    k = rest.shape[1]
    return g, np.maximum(20000.0, 4 * (rest[:, (k - 1) // 2] + rest[:, k // 2]) / 2)


def repair_orders(x: np.ndarray, y: np.ndarray, most: int = 3) -> np.ndarray:
    """As ``repair_order``, for many lines of one length (3 or more stops) at once: a row a line."""
    n, size = x.shape
    order = np.tile(np.arange(size, dtype=np.int32), (n, 1))
    todo = np.arange(n)
    at = lambda v, rows, o: np.take_along_axis(v[rows], o, 1)
    for step in range(most + 1):
        g, limit = _gaps_of_all(at(x, todo, order[todo]), at(y, todo, order[todo]))
        wide = g > limit[:, None]
        todo, wide = todo[wide.any(1)], wide[wide.any(1)]
        if step == most or not len(todo):
            break
        k = wide.argmax(1)
        out = np.where(k == 0, 0, k + 1)
        own = order[todo]
        moved = np.take_along_axis(own, out[:, None], 1)
        own = own[np.arange(size) != out[:, None]].reshape(len(todo), size - 1)
        px, py, mx, my = at(x, todo, own), at(y, todo, own), at(x, todo, moved), at(y, todo, moved)
        to, gone = metres(px, py, mx, my), np.zeros((len(todo), 1))
        between = metres(px[:, :-1], py[:, :-1], px[:, 1:], py[:, 1:])
        costs = np.hstack([gone, to]) + np.hstack([to, gone]) - np.hstack([gone, between, gone])
        place = costs.argmin(1)[:, None]
        slot = np.arange(size)
        order[todo] = np.where(slot == place, moved, np.take_along_axis(own, np.minimum(np.where(slot > place, slot - 1, slot), size - 2), 1))
    order[todo] = np.arange(size)
    return order


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _repaired(lon: pd.Series, lat: pd.Series) -> pd.Series:
    """Lines of one length are repaired together."""
    size, out = lon.map(len).to_numpy(int), np.empty(len(lon), object)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        found = repair_orders(*(np.stack([np.asarray(v, float) for v in c.iloc[rows]]) for c in (lon, lat))) if n > 2 else np.tile(np.arange(n), (len(rows), 1))
        for k, order in zip(rows, found, strict=True):
            out[k] = order
    return pd.Series(out)


def chain(ways: list[list[tuple]]) -> list[list[tuple]]:
    """Ways joined end to end where their ends are the same point; each chain starts at the first way left, and grows at both
    ends by the first way left that touches one."""
    return [line for _, line in chains([w for w in ways if len(w) > 1])]


def chains(ways: list[list[tuple]]) -> list[tuple[int, list[tuple]]]:
    """As ``chain``, with the position of each chain's first way. Ways have two points or more."""
    used, touching, out = [False] * len(ways), defaultdict(list), []
    for k, w in enumerate(ways):
        for p in {w[0], w[-1]}:
            touching[p].append(k)  # in order, so a heap

    def first(p: tuple) -> int:
        left = touching[p]
        while left and used[left[0]]:
            heapq.heappop(left)
        return left[0] if left else len(ways)

    for k, w in enumerate(ways):
        if used[k]:
            continue
        used[k], line = True, deque(w)
        while (j := min(first(line[-1]), first(line[0]))) < len(ways):
            used[j], w = True, ways[j]
            if w[0] == line[-1]:
                line.extend(w[1:])
            elif w[-1] == line[-1]:
                line.extend(w[-2::-1])
            elif w[-1] == line[0]:
                line.extendleft(w[-2::-1])
            else:
                line.extendleft(w[1:])
        out.append((k, list(line)))
    return out


def stitch_ways(ways: DataFrame, key: str = "relation", whole: int = 5000) -> DataFrame:
    """(relation, part, line): each relation's ways chained. ways: (relation, ord, line); ways of one point are left out.

    A relation of at most ``whole`` ways is chained as one row, by the ends of its ways alone. In larger ones, and those with
    ends without a place, only ways that share ends, directly or through others, meet in a task. A relation's chains are numbered by their first way.
    """
    kind, order = ways.schema[key].dataType.simpleString(), ways.schema["ord"].dataType.simpleString()
    w = save(ways.filter(F.size("line") > 1).select(key, "ord", "line"))
    odd = reduce(lambda x, y: x | y, (v.isNull() | F.isnan(v.cast("double")) for v in (F.element_at("line", k)[c] for k in (1, -1) for c in "xy")))
    many = save(w.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(odd, F.lit(True))).alias("odd")).filter((F.col("n") > whole) | F.col("odd")).select(key))
    small = w.join(F.broadcast(many), key, "left_anti").filter(F.col(key).isNotNull())
    s = small.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("w"))
    of_all = lambda k, c: F.transform("w", lambda v: F.element_at(v["line"], k)[c])
    s = s.select(key, "w", F.posexplode(_chained(*(of_all(k, c) for k in (1, -1) for c in "xy"))).alias("part", "chain"))
    # a way of the chain is k + 1, or -(k + 1) if it runs backwards; all but the first give up the point they share
    one = lambda v: F.when(v > 0, F.get("w", v - 1)["line"]).otherwise(F.reverse(F.get("w", -v - 1)["line"]))
    line = F.flatten(F.transform("chain", lambda v, i: F.when(i == 0, one(v)).otherwise(F.slice(one(v), 2, F.size(one(v)) - 1))))
    out = s.select(key, "part", line.alias("line"))
    if many.isEmpty() and w.filter(F.col(key).isNull()).isEmpty():
        return out

    end = lambda k: F.concat_ws(" ", F.element_at("line", k)["x"] + F.lit(0.0), F.element_at("line", k)["y"] + F.lit(0.0), F.col(key).cast("string"))
    w = w.join(F.broadcast(many), key, "left_semi").unionByName(w.filter(F.col(key).isNull())).select(key, "ord", "line", end(1).alias("a"), end(-1).alias("b"))
    ends = w.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    parts = connected_components(ends, w.select("a", "b")).select(F.col("node").alias("a"), "component")

    def one_part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        found = chains([[(p["x"], p["y"]) for p in line] for line in pdf["line"]])
        first = pdf.iloc[[k for k, _ in found]]
        return pd.DataFrame({key: first[key].to_numpy(), "ord": first["ord"].to_numpy(), "line": [[{"x": x, "y": y} for x, y in line] for _, line in found]})

    w = w.join(parts, "a").drop("a", "b").groupBy("component").applyInPandas(one_part, f"{key} {kind}, ord {order}, line array<struct<x:double,y:double>>")
    place = F.row_number().over(Window.partitionBy(key).orderBy("ord", F.col("line"))) - 1
    return out.unionByName(w.select(key, place.cast("int").alias("part"), "line"))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _chained(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
    return pd.Series([chained_ends(list(zip((a + 0.0).tolist(), (b + 0.0).tolist(), strict=True)), list(zip((c + 0.0).tolist(), (d + 0.0).tolist(), strict=True))) for a, b, c, d in zip(ax, ay, bx, by, strict=True)], dtype=object)


def chained_ends(a: list, b: list) -> list[list[int]]:
    """As ``chains``, by the ends of the ways: each chain's ways along it, k + 1 for way k and -(k + 1) for one run backwards."""
    used, touching, out = [False] * len(a), defaultdict(list), []
    for k, (p, q) in enumerate(zip(a, b, strict=True)):
        touching[p].append(k)
        if p != q:
            touching[q].append(k)
    after: dict = dict.fromkeys(touching, 0)  # where each list's first way left may be

    def first(p) -> int:
        left, i = touching[p], after[p]
        while i < len(left) and used[left[i]]:
            i += 1
        after[p] = i
        return left[i] if i < len(left) else len(a)

    for k in range(len(a)):
        if used[k]:
            continue
        used[k], way, head, tail = True, deque([k + 1]), a[k], b[k]
        while (j := min(first(tail), first(head))) < len(a):
            used[j] = True
            if a[j] == tail:
                way.append(j + 1)
                tail = b[j]
            elif b[j] == tail:
                way.append(-j - 1)
                tail = a[j]
            elif b[j] == head:
                way.appendleft(j + 1)
                head = a[j]
            else:
                way.appendleft(-j - 1)
                head = b[j]
        out.append(list(way))
    return out


def bridge_gaps(lines: list[np.ndarray], least_m: float = 1.0, most_m: float = 1500.0, facing: float = -0.95, ahead: float = 0.9) -> list[np.ndarray]:
    """Lines joined across gaps: the nearest pair of ends that face each other and lie ahead of each other, again and again."""
    lines = [np.asarray(x, float) for x in lines]

    def end(line: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
        a, b = (line[-1], line[-2]) if last else (line[0], line[1])
        d = (a - b) * [math.cos(math.radians(a[1])), 1]
        return a, d / (np.hypot(*d) or 1)

    while True:
        best = None
        for i in range(len(lines)):
            for j in range(i + 1, len(lines)):
                for e in (False, True):
                    for f in (False, True):
                        (p, u), (q, v) = end(lines[i], e), end(lines[j], f)
                        d = float(metres(*p, *q))
                        way = (q - p) * [math.cos(math.radians(p[1])), 1]
                        way = way / (np.hypot(*way) or 1)
                        if least_m <= d <= most_m and u @ v <= facing and u @ way >= ahead and (best is None or d < best[0]):
                            best = (d, i, j, e, f)
        if best is None:
            return lines
        _, i, j, e, f = best
        a = lines[i] if e else lines[i][::-1]
        b = lines[j][::-1] if f else lines[j]
        lines = [x for k, x in enumerate(lines) if k not in (i, j)] + [np.concatenate([a, b])]


def parallel_duplicates(lines: list[np.ndarray], near_m: float = 30.0, along: float = 0.966, samples: int = 12) -> list[int]:
    """Positions of lines to keep, the longest first: a shorter line goes if it runs along a kept one, all samples within 30 m."""
    lines = [np.asarray(x, float) for x in lines]
    length = [float(metres(x[:-1, 0], x[:-1, 1], x[1:, 0], x[1:, 1]).sum()) for x in lines]
    kept: list[int] = []
    for k in sorted(range(len(lines)), key=lambda i: (-length[i], i)):
        if not any(_runs_along(lines[k], lines[j], near_m, along, samples) for j in kept):
            kept.append(k)
    return sorted(kept)


def _runs_along(line: np.ndarray, other: np.ndarray, near_m: float, along: float, samples: int) -> bool:
    scale = np.array([DEGREE_M * math.cos(math.radians(float(line[:, 1].mean()))), DEGREE_M])
    a, b = line * scale, other * scale
    u, v = a[-1] - a[0], b[-1] - b[0]
    if abs(u @ v) < along * np.hypot(*u) * np.hypot(*v):
        return False
    pts = a[np.unique(np.linspace(0, len(a) - 1, samples).round().astype(int))]
    p, q = b[:-1], b[1:]
    d = q - p
    n2 = np.maximum((d**2).sum(1), 1e-12)
    t = np.clip(((pts[:, None] - p) * d).sum(2) / n2, 0, 1)
    return bool((np.hypot(*(pts[:, None] - p - t[..., None] * d).transpose(2, 0, 1)).min(1) <= near_m).all())


def grouped_lines(lines: DataFrame, key: str, step: str) -> DataFrame:
    """(key, part, line): ``bridge`` or ``parallel`` applied within each group of lines that can touch."""
    kind = lines.schema[key].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        xy = [np.array([(p["x"], p["y"]) for p in v]) for v in pdf["line"]]
        xy = [x for x in xy if len(x) > 1]
        out = bridge_gaps(xy) if step == "bridge" else [xy[k] for k in parallel_duplicates(xy)]
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(out), "part": range(len(out)), "line": [[{"x": float(x), "y": float(y)} for x, y in v] for v in out]})

    return lines.select(key, "ord", "line").groupBy(key).applyInPandas(one, f"{key} {kind}, part int, line array<struct<x:double,y:double>>")


def voronoi_cells(points: DataFrame, key: str, box: tuple[float, float, float, float]) -> DataFrame:
    """(question, key, cell): the planar cell of each of a question's candidates; equal places keep the first."""
    from waymark.functions.kernels import LINE, voronoi

    p = first_by(points.withColumn("__x", F.round("lon", 6)).withColumn("__y", F.round("lat", 6)), ["question", "__x", "__y"], F.col(key))
    p = p.select("question", key, "lon", "lat")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        return pd.DataFrame({"question": pdf["question"], key: pdf[key], "cell": voronoi(list(zip(pdf["lon"], pdf["lat"], strict=True)), box)})

    kinds = {f.name: f.dataType.simpleString() for f in p.schema}
    return p.groupBy("question").applyInPandas(one, f"question {kinds['question']}, {key} {kinds[key]}, cell {LINE.simpleString()}")
