"""Exact overlay, dissolve, repair and buffers of polygons, as joins and sums over edges.

Polygons become directed edges on an integer grid, interior to the left. Four steps follow, each a shuffle by cell or node,
so that no task sees a whole shape however large it is:

1. **noding**: edges that share a cell are cut where they meet; cut points are rounded to the grid, and edges that rounding
   bent are tried again until nothing crosses. Equal edges merge; opposite ones cancel.
2. **winding**: for each layer, how often its rings go round the left and the right of an edge. The count at a cell's left
   border is a running sum over the crossings of that border line; from there to the edge's middle only edges of the same
   cell are crossed.
3. **selection**: edges with a result on one side only are its boundary, turned so that it lies to the left. Union,
   intersection, difference, dissolve and even-odd repair differ only in the rule from winding numbers to in or out.
4. **rings**: at each node an edge is followed by the next one clockwise; connected edges form rings, and holes go to the
   smallest ring around them.

Coordinates are multiples of ``grid`` (1e-8 degrees is about a millimetre). Products of differences stay exact in 64 bits
while an edge is shorter than 2^30 grid units (10 degrees by default); a longer one raises an error, so pass a coarser grid.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import kernels, rings
from waymark.operators.graph import connected_components
from waymark.session import save

GRID = 1e-8
ENDS = ("ax", "ay", "bx", "by")
Rule = Callable[[Column, Column], Column]


def positive(a: Column, b: Column) -> Column:
    """In what the first layer covers at least once."""
    return a > 0


def even_odd(a: Column, b: Column) -> Column:
    return a % 2 != 0


def union(a: Column, b: Column) -> Column:
    return (a > 0) | (b > 0)


def intersection(a: Column, b: Column) -> Column:
    return (a > 0) & (b > 0)


def difference(a: Column, b: Column) -> Column:
    return (a > 0) & ~(b > 0)


def symmetric_difference(a: Column, b: Column) -> Column:
    return (a > 0) != (b > 0)


def edges_of(polygons: DataFrame, key: list[str], multi: str = "multi", layer: int = 0, grid: float = GRID, turn: bool = True) -> DataFrame:
    """(key, ax, ay, bx, by, da, db): the edges of all rings on the grid, unclosed rings closed; da or db is 1 by the layer.

    With ``turn``, outer rings run counter-clockwise and holes clockwise, whatever they did before. Null shapes, and rings
    of fewer than three points, have no edges; points that are null or not finite are left out.
    """
    p = polygons.select(*key, F.explode(multi).alias("__polygon")).select(*key, F.posexplode("__polygon").alias("__ring", "__line"))
    at = lambda v: F.floor(v / grid + 0.5).cast("long")
    clean = F.filter("__line", lambda q: q.isNotNull() & rings.valid_point(q))
    p = p.withColumn("__line", F.transform(clean, lambda q: F.struct(at(q["x"]).alias("x"), at(q["y"]).alias("y")))).filter(F.size("__line") >= 3)
    p = p.withColumn("__line", F.when(F.element_at("__line", 1) == F.element_at("__line", -1), F.col("__line")).otherwise(F.concat("__line", F.slice("__line", 1, 1))))
    if turn:
        area = F.aggregate(
            F.sequence(F.lit(1), F.size("__line") - 1), F.lit(0.0),
            lambda acc, i: acc + (_of(i)["x"] - _of(1)["x"]).cast("double") * (_of(i + 1)["y"] - _of(1)["y"]) - (_of(i + 1)["x"] - _of(1)["x"]).cast("double") * (_of(i)["y"] - _of(1)["y"]),
        )
        p = p.withColumn("__line", F.when((area > 0) == (F.col("__ring") == 0), F.col("__line")).otherwise(F.reverse("__line")))
    n = F.size("__line") - 1
    pairs = F.arrays_zip(F.slice("__line", 1, n).alias("a"), F.slice("__line", 2, n).alias("b"))
    e = p.select(*key, F.explode(pairs).alias("e")).select(*key, *(F.col(f"e.{v[0]}.{v[1]}").alias(v) for v in ENDS))
    return e.withColumn("da", F.lit(int(layer == 0)).cast("long")).withColumn("db", F.lit(int(layer == 1)).cast("long"))


def _of(i: Column | int) -> Column:
    return F.element_at("__line", i if isinstance(i, Column) else F.lit(i))


def _merged(edges: DataFrame, key: list[str]) -> DataFrame:
    """Equal edges as one, drawn upwards, or eastwards where level, with the sums of their layers' signs. Points go."""
    up = (F.col("ay") < F.col("by")) | ((F.col("ay") == F.col("by")) & (F.col("ax") < F.col("bx")))
    turned = edges.filter("ax <> bx OR ay <> by").select(
        *key, *(F.when(up, F.col(v)).otherwise(F.col(("b" if v[0] == "a" else "a") + v[1])).alias(v) for v in ENDS),
        *(F.when(up, F.col(d)).otherwise(-F.col(d)).alias(d) for d in ("da", "db")), "bent",
    )
    return turned.groupBy(*key, *ENDS).agg(F.sum("da").alias("da"), F.sum("db").alias("db"), F.bool_or("bent").alias("bent"))


def _cell_of(v: Column, cell: int) -> Column:
    return ((v - F.pmod(v, F.lit(cell))) / cell).cast("long")


def _cells(edges: DataFrame, cell: int) -> DataFrame:
    """A row for each cell (cx, cy) that an edge passes, with one grid unit to spare: column by column, by its length."""
    e = edges.withColumn("cx", F.explode(F.sequence(_cell_of(F.least("ax", "bx") - 1, cell), _cell_of(F.greatest("ax", "bx") + 1, cell))))
    dx = F.nullif((F.col("bx") - F.col("ax")).cast("double"), F.lit(0.0))
    part = lambda x, whole: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce((x - F.col("ax")) / dx, F.lit(whole))))
    y = lambda t: F.col("ay") + t * (F.col("by") - F.col("ay"))
    y1, y2 = y(part(F.col("cx") * cell - 1.0, 0.0)), y(part((F.col("cx") + 1) * cell + 1.0, 1.0))
    low, high = F.floor(F.least(y1, y2) - 1.5).cast("long"), F.floor(F.greatest(y1, y2) + 1.5).cast("long")
    return e.withColumn("cy", F.explode(F.sequence(_cell_of(low, cell), _cell_of(high, cell))))


def cell_size(edges: DataFrame) -> int:
    """Cells of twice the mean extent of an edge: edges then pass one or two cells on average. Raises where an edge is too long for exact products."""
    longest, mean = edges.select(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))).alias("m")).agg(F.max("m"), F.avg("m")).first()
    if (longest or 0) >= 1 << 30:
        raise ValueError("an edge is longer than 2^30 grid units: pass a coarser grid")
    return max(16, min(1 << 29, math.ceil(2 * (mean or 8))))


def noded(edges: DataFrame, key: list[str], cell: int | None = None, rounds: int = 12) -> tuple[DataFrame, int]:
    """Distinct edges (key, ax, ay, bx, by, da, db) that meet at ends only, and a cell size that suits them.

    Without a given cell each round's cells suit its edges: cut edges are shorter, and cells of the first size would hold
    ever more of them.
    """
    edges = save(_merged(edges.withColumn("bent", F.lit(True)), key).withColumn("id", F.monotonically_increasing_id()))
    given, cell = cell, cell or cell_size(edges)
    for _ in range(rounds):
        tiled = _cells(edges.drop("da", "db"), cell)
        # cells in which something may cross that has not been tried
        tiled = save(tiled)
        live = tiled.filter("bent").select(*key, "cx", "cy").distinct()
        mine = tiled.join(live, [*key, "cx", "cy"], "left_semi")
        other = mine.select(*key, "cx", "cy", F.col("id").alias("id2"), F.col("bent").alias("bent2"), *(F.col(v).alias({"a": "e", "b": "f"}[v[0]] + v[1]) for v in ENDS))
        met = mine.join(other, [*key, "cx", "cy"]).filter((F.col("id") < F.col("id2")) & (F.col("bent") | F.col("bent2")) & _boxes_touch()).drop("cx", "cy")
        cuts = save(_cuts(met, key).distinct())
        if cuts.isEmpty():
            return edges.drop("id", "bent"), cell
        split = edges.join(cuts.groupBy("id").agg(F.collect_list(F.struct("x", "y")).alias("cuts"), F.bool_or("off").alias("off")), "id", "left")
        along = F.transform("cuts", lambda q: F.struct(((q["x"] - F.col("ax")).cast("double") * (F.col("bx") - F.col("ax")) + (q["y"] - F.col("ay")).cast("double") * (F.col("by") - F.col("ay"))).alias("t"), q["x"].alias("x"), q["y"].alias("y")))
        end = lambda v: F.array(F.struct(F.col(v + "x").alias("x"), F.col(v + "y").alias("y")))
        chain = F.when(F.col("cuts").isNull(), F.concat(end("a"), end("b"))).otherwise(F.concat(end("a"), F.transform(F.array_sort(along), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))), end("b")))
        split = split.select(*key, "da", "db", F.coalesce("off", F.lit(False)).alias("bent"), chain.alias("chain"))
        n = F.size("chain") - 1
        pieces = split.select(*key, "da", "db", "bent", F.explode(F.arrays_zip(F.slice("chain", 1, n).alias("a"), F.slice("chain", 2, n).alias("b"))).alias("e"))
        pieces = pieces.select(*key, "da", "db", "bent", *(F.col(f"e.{v[0]}.{v[1]}").alias(v) for v in ENDS))
        edges = save(_merged(pieces, key).withColumn("id", F.monotonically_increasing_id()))
        cell = given or cell_size(edges)
        if edges.filter("bent").isEmpty():
            return edges.drop("id", "bent"), cell
    raise RuntimeError("edges did not settle on the grid")


def _boxes_touch() -> Column:
    low, high = (lambda v, w: F.least(v, w)), (lambda v, w: F.greatest(v, w))
    meets = [(low(f"a{v}", f"b{v}") <= high(f"e{v}", f"f{v}")) & (low(f"e{v}", f"f{v}") <= high(f"a{v}", f"b{v}")) for v in "xy"]
    return meets[0] & meets[1]


def _cuts(met: DataFrame, key: list[str]) -> DataFrame:
    """(id, x, y, off): where an edge must be cut; off: the point was rounded, so that the parts bend away from the edge."""
    c = F.col
    ux, uy, vx, vy = c("bx") - c("ax"), c("by") - c("ay"), c("fx") - c("ex"), c("fy") - c("ey")
    wx, wy = c("ex") - c("ax"), c("ey") - c("ay")
    met = met.withColumn("den", ux * vy - uy * vx).withColumn("tn", wx * vy - wy * vx).withColumn("un", wx * uy - wy * ux)
    sign = F.when(c("den") < 0, -1).otherwise(1)
    den, tn, un = F.abs("den"), c("tn") * sign, c("un") * sign
    crossing = (den > 0) & (tn >= 0) & (tn <= den) & (un >= 0) & (un <= den)
    # the point along the edge whose share is nearer to an end is as exact as any; ends are taken as they are
    x = F.when(un == 0, c("ex")).when(un == den, c("fx")).when(tn == 0, c("ax")).when(tn == den, c("bx")).otherwise(F.floor(c("ax") + tn.cast("double") / den * ux + 0.5).cast("long"))
    y = F.when(un == 0, c("ey")).when(un == den, c("fy")).when(tn == 0, c("ay")).when(tn == den, c("by")).otherwise(F.floor(c("ay") + tn.cast("double") / den * uy + 0.5).cast("long"))
    level = (c("den") == 0) & (c("tn") == 0) & (wx * uy == wy * ux)
    point = lambda i, px, py: F.struct(c(i).alias("id"), px.alias("x"), py.alias("y"))
    found = F.when(crossing, F.array(point("id", x, y), point("id2", x, y))).when(
        level, F.array(point("id", c("ex"), c("ey")), point("id", c("fx"), c("fy")), point("id2", c("ax"), c("ay")), point("id2", c("bx"), c("by")))
    )
    rows = met.filter(crossing | level).select("id", "id2", *ENDS, "ex", "ey", "fx", "fy", F.explode(found).alias("p"))
    own = c("p.id") == c("id")
    e = [F.when(own, c(v)).otherwise(c({"a": "e", "b": "f"}[v[0]] + v[1])) for v in ENDS]
    rows = rows.select(c("p.id").alias("id"), c("p.x").alias("x"), c("p.y").alias("y"), *(v.alias(n) for v, n in zip(e, ENDS, strict=True)))
    inside = c("x").between(F.least("ax", "bx"), F.greatest("ax", "bx")) & c("y").between(F.least("ay", "by"), F.greatest("ay", "by"))
    at_end = ((c("x") == c("ax")) & (c("y") == c("ay"))) | ((c("x") == c("bx")) & (c("y") == c("by")))
    off = (c("bx") - c("ax")) * (c("y") - c("ay")) != (c("by") - c("ay")) * (c("x") - c("ax"))
    return rows.filter(inside & ~at_end).select("id", "x", "y", off.alias("off"))


def labelled(edges: DataFrame, key: list[str], cell: int) -> DataFrame:
    """Adds la, lb, ra, rb: both layers' winding numbers left and right of each noded edge, which runs upwards or eastwards."""
    edges = save(edges.filter("da <> 0 OR db <> 0").withColumn("id", F.monotonically_increasing_id()))
    c = F.col
    # edges across the line half a unit left of each column of cells: where, and which way
    lines = edges.withColumn("cx", F.explode(F.filter(F.sequence(_cell_of(F.least("ax", "bx"), cell), _cell_of(F.greatest("ax", "bx"), cell)), lambda k: (c("ax") < k * cell) != (c("bx") < k * cell))))
    y = c("ay") + (c("by") - c("ay")) * (c("cx") * cell - 0.5 - c("ax")) / F.nullif((c("bx") - c("ax")).cast("double"), F.lit(0.0))
    row = F.floor((y + 0.5) / cell).cast("long")
    sign = F.when(c("ax") < c("bx"), 1).otherwise(-1)  # eastwards: its left is above
    borders = lines.select(*key, "cx", row.alias("cy"), (sign * c("da")).alias("a"), (sign * c("db")).alias("b")).groupBy(*key, "cx", "cy").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # the middle of each edge, in half units
    mid = edges.withColumn("px", c("ax") + c("bx")).withColumn("py", c("ay") + c("by"))
    mid = mid.withColumn("cx", _cell_of(c("px") + 1, 2 * cell)).withColumn("cy", _cell_of(c("py") + 1, 2 * cell))
    need = mid.select(*key, "cx", "cy").distinct().select(*key, "cx", "cy", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    both = borders.unionByName(need).groupBy(*key, "cx", "cy").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    below = Window.partitionBy(*key, "cx").orderBy("cy").rowsBetween(Window.unboundedPreceding, -1)
    base = both.select(*key, "cx", "cy", F.coalesce(F.sum("a").over(below), F.lit(0)).alias("base_a"), F.coalesce(F.sum("b").over(below), F.lit(0)).alias("base_b"))
    # from the border line to the middle: edges below on the line, in this row of cells, and edges across the level way
    tiled = _cells(edges, cell).select(*key, "cx", "cy", c("id").alias("id2"), c("ax").alias("ex"), c("ay").alias("ey"), c("bx").alias("fx"), c("by").alias("fy"), c("da").alias("ea"), c("db").alias("eb"))
    met = mid.select(*key, "cx", "cy", "id", "px", "py").join(tiled, [*key, "cx", "cy"])
    dx, dy = c("fx") - c("ex"), c("fy") - c("ey")
    qx = 2 * c("cx") * cell - 1
    side = lambda x: dx * (c("py") - 2 * c("ey")) - dy * (x - 2 * c("ex"))  # noqa: E731  above 0: left of the edge
    border = (c("ex") < c("cx") * cell) != (c("fx") < c("cx") * cell)
    line_y = c("ey") + dy * (c("cx") * cell - 0.5 - c("ex")) / F.nullif(dx.cast("double"), F.lit(0.0))
    here = border & (F.floor((line_y + 0.5) / cell).cast("long") == c("cy"))
    east = F.when(dx > 0, 1).otherwise(-1)
    under = F.when(here & (F.when(dx > 0, side(qx) >= 0).otherwise(side(qx) <= 0)), east).otherwise(0)
    rises = (2 * c("ey") <= c("py")) & (c("py") < 2 * c("fy"))
    right_of_line = (side(qx) > 0) | ((side(qx) == 0) & (dx > 0))
    crossed = F.when(rises & (c("id") != c("id2")) & right_of_line & (side(c("px")) < 0), -1).otherwise(0)
    got = met.select(*key, "cx", "cy", "id", ((under + crossed) * c("ea")).alias("a"), ((under + crossed) * c("eb")).alias("b")).groupBy(*key, "cx", "cy", "id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    got = got.join(base, [*key, "cx", "cy"]).select("id", (c("a") + c("base_a")).alias("la"), (c("b") + c("base_b")).alias("lb"))
    return edges.join(got, "id").select(*key, *ENDS, "la", "lb", (c("la") - c("da")).alias("ra"), (c("lb") - c("db")).alias("rb"))


def arranged(edges: DataFrame, key: list[str], cell: int | None = None) -> DataFrame:
    """Edges noded and labelled, written once: any number of rules can then select from them."""
    cut, cell = noded(edges, key, cell)
    return save(labelled(cut, key, cell))


def select(out: DataFrame, key: list[str], rule: Rule) -> DataFrame:
    """(key, ax, ay, bx, by): of arranged edges, the boundary of what the rule takes, with its inside to the left."""
    left, right = rule(F.col("la"), F.col("lb")), rule(F.col("ra"), F.col("rb"))
    out = out.withColumn("__left", left).filter(left != right)
    return out.select(*key, *(F.when(F.col("__left"), F.col(v)).otherwise(F.col(("b" if v[0] == "a" else "a") + v[1])).alias(v) for v in ENDS))


def boundary(edges: DataFrame, key: list[str], rule: Rule, cell: int | None = None) -> DataFrame:
    """(key, ax, ay, bx, by): the boundary of what the rule takes of the edges' winding numbers."""
    return select(arranged(edges, key, cell), key, rule)


def areas(edges: DataFrame, key: list[str], grid: float = GRID) -> DataFrame:
    """(key, area): the signed area that a boundary encloses, in square degrees; no ring is formed. Sums are taken around each edge's own cell of 2^24 units, so they stay exact."""
    c, far = F.col, 1 << 24
    x0, y0 = (_cell_of(c(v), far) * far for v in ("ax", "ay"))
    # shifting by (x0, y0) changes x dy by x0 dy: those sums are kept apart, as whole numbers
    part = (c("ax") - x0 + c("bx") - x0).cast("double") * (c("by") - c("ay")) / 2
    return edges.groupBy(*key).agg((F.sum(part) + F.sum(x0.cast("decimal(18,0)") * (c("by") - c("ay")).cast("decimal(18,0)")).cast("double")).alias("area")).select(*key, (c("area") * grid * grid).alias("area"))


def ring_rows(edges: DataFrame, key: list[str], grid: float = GRID) -> DataFrame:
    """(key, ring, line, area): the rings of a boundary, closed, without points on straight stretches; area above 0 runs counter-clockwise.

    A ring begins at its lowest westernmost point, so equal boundaries give equal rings. Only what belongs to one ring is
    gathered in one place.
    """
    e = save(edges.withColumn("id", F.monotonically_increasing_id()))
    c = F.col
    away = e.select(*key, c("ax").alias("x"), c("ay").alias("y"), "id", F.lit(True).alias("out"), F.atan2((c("by") - c("ay")).cast("double"), (c("bx") - c("ax")).cast("double")).alias("turn"))
    back = e.select(*key, c("bx").alias("x"), c("by").alias("y"), "id", F.lit(False).alias("out"), F.atan2((c("ay") - c("by")).cast("double"), (c("ax") - c("bx")).cast("double")).alias("turn"))
    node = Window.partitionBy(*key, "x", "y")
    out = F.when(c("out"), c("id"))
    before = F.last(out, ignorenulls=True).over(node.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    last = F.max_by(out, F.when(c("out"), c("turn"))).over(node)
    follows = save(away.unionByName(back).withColumn("next", F.coalesce(before, last)).filter(~c("out")).select("id", "next"))
    comp = connected_components(e.select(c("id").alias("node")), follows.select(c("id").alias("a"), c("next").alias("b")))
    rows = e.join(follows, "id").join(comp.select(c("node").alias("id"), c("component").alias("ring")), "id")
    schema = T.StructType([*(f for f in e.schema if f.name in key), T.StructField("ring", T.LongType()), T.StructField("line", kernels.LINE), T.StructField("area", T.DoubleType())])

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        at = {i: k for k, i in enumerate(pdf["id"].tolist())}
        follow = [at[n] for n in pdf["next"].tolist()]
        xy = pdf[["ax", "ay"]].to_numpy(np.int64)
        start = int(np.lexsort((xy[:, 1], xy[:, 0]))[0])
        order, k = [], start
        while True:
            order.append(k)
            k = follow[k]
            if k == start:
                break
        p = _straightened(xy[order])
        x, y = (p - p[0]).astype(float).T
        area = float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2) * grid * grid
        line = [{"x": float(a), "y": float(b)} for a, b in np.round(np.concatenate([p, p[:1]]) * grid, 12)]
        head = {k: [pdf[k].iloc[0]] for k in key}
        return pd.DataFrame(head | {"ring": [int(pdf["ring"].iloc[0])], "line": [line], "area": [area]})

    return rows.groupBy(*key, "ring").applyInPandas(trace, schema)


def _straightened(p: np.ndarray) -> np.ndarray:
    """A ring of whole numbers without points on straight stretches; the first point stays a corner, since it is the ring's lowest westernmost."""
    u, v = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
    bend = u[:, 0] * v[:, 1] != u[:, 1] * v[:, 0]
    return p[bend] if bend.sum() >= 3 else p


def polygons(edges: DataFrame, key: list[str], grid: float = GRID) -> DataFrame:
    """(key, polygon, area): each outer ring with the holes directly inside it, and its area less theirs in square degrees."""
    r = save(ring_rows(edges, key, grid))
    outer, hole = r.filter("area > 0"), r.filter("area < 0")
    box = rings.bounds(F.col("line"))
    out = outer.select(*key, F.col("ring").alias("o"), F.col("line").alias("o_line"), F.col("area").alias("o_area"), box.alias("box"))
    size = r.agg(F.avg(F.greatest(box["e"] - box["w"], box["n"] - box["s"]))).first()[0] or 1.0
    at = lambda v: F.floor(v / size).cast("long")
    tiles = out.withColumn("cx", F.explode(F.sequence(at(F.col("box.w")), at(F.col("box.e"))))).withColumn("cy", F.explode(F.sequence(at(F.col("box.s")), at(F.col("box.n")))))
    p, q = F.element_at("line", 1), F.element_at("line", 2)
    # a point of the hole's edge that is no corner, so that it lies on no other ring's corner
    h = hole.withColumn("mx", (p["x"] + q["x"]) / 2).withColumn("my", (p["y"] + q["y"]) / 2).withColumn("cx", at(F.col("mx"))).withColumn("cy", at(F.col("my")))
    holds = F.col("mx").between(F.col("box.w"), F.col("box.e")) & F.col("my").between(F.col("box.s"), F.col("box.n")) & (F.col("o_area") > -F.col("area"))
    home = h.join(tiles, [*key, "cx", "cy"]).filter(holds).filter(rings.point_in_ring("mx", "my", F.col("o_line")))
    home = home.groupBy(*key, "ring").agg(F.min_by("o", "o_area").alias("o"), F.first("line").alias("line"), F.first("area").alias("area"))
    inner = home.groupBy(*key, "o").agg(F.transform(F.array_sort(F.collect_list(F.struct("area", "line"))), lambda v: v["line"]).alias("holes"), F.sum("area").alias("less"))
    none = F.array().cast(T.ArrayType(kernels.LINE))
    return out.join(inner, [*key, "o"], "left").select(*key, F.concat(F.array("o_line"), F.coalesce("holes", none)).alias("polygon"), (F.col("o_area") + F.coalesce("less", F.lit(0.0))).alias("area"))


# --- whole operations


def arranged_pair(a: DataFrame, b: DataFrame, key: list[str], multi: str = "multi", grid: float = GRID, cell: int | None = None) -> DataFrame:
    """Each key's polygons in a and in b as one arrangement, to ``select`` several overlays from."""
    return arranged(edges_of(a, key, multi, 0, grid).unionByName(edges_of(b, key, multi, 1, grid)), key, cell)


def overlay(a: DataFrame, b: DataFrame, key: list[str], rule: Rule, multi: str = "multi", grid: float = GRID, cell: int | None = None) -> DataFrame:
    """The boundary of an overlay of each key's polygons in a and in b: ``union``, ``intersection``, ``difference`` or ``symmetric_difference``.

    Overlapping polygons of one side count as their union. A key on one side only meets nothing on the other.
    """
    return select(arranged_pair(a, b, key, multi, grid, cell), key, rule)


def dissolve(shapes: DataFrame, key: list[str], multi: str = "multi", grid: float = GRID, cell: int | None = None) -> DataFrame:
    """The boundary of the union of all polygons of each key. Borders between neighbours cancel; any cell size gives the same."""
    return boundary(edges_of(shapes, key, multi, 0, grid), key, positive, cell)


def repair(shapes: DataFrame, key: list[str], multi: str = "multi", grid: float = GRID, cell: int | None = None) -> DataFrame:
    """The boundary of what the rings of each key enclose an odd number of times: bow ties fall into their lobes, spikes and doubled edges go."""
    return boundary(edges_of(shapes, key, multi, 0, grid, turn=False), key, even_odd, cell)


def offset_ring(xy: np.ndarray, radius: float, steps: int = 8) -> np.ndarray:
    """A closed curve around a line, with round ends and joins of ``steps`` parts a quarter turn.

    On the inner side of a bend it runs through the bend itself, so that the curve is the sum of the outlines of one box a
    segment and one wedge a bend: what it goes round at least once is the buffer.
    """
    xy = xy[np.append(True, (np.diff(xy, axis=0) != 0).any(1))] if len(xy) else xy
    quarter = math.pi / 2 / steps
    arc = lambda c, a, b: [c + radius * np.array([math.cos(t), math.sin(t)]) for t in np.linspace(a, b, max(2, math.ceil(abs(b - a) / quarter - 1e-9) + 1))]
    if len(xy) == 1:
        return np.array(arc(xy[0], 0.0, 2 * math.pi))
    out: list[np.ndarray] = []
    way = np.concatenate([xy, xy[-2::-1]])
    turn = [math.atan2(d[1], d[0]) for d in np.diff(way, axis=0)]
    for i, a in enumerate(turn):
        b = turn[(i + 1) % len(turn)]
        end = way[i + 1]
        bend = (b - a + math.pi) % (2 * math.pi) - math.pi
        if i + 1 in (len(xy) - 1, len(way) - 1):
            bend = math.pi  # round the end of the line
        out.append(way[i] + radius * np.array([math.cos(a - math.pi / 2), math.sin(a - math.pi / 2)]))
        if bend >= 0:  # the right-hand side is the outer one
            out += arc(end, a - math.pi / 2, a - math.pi / 2 + bend)
        else:
            out += [end + radius * np.array([math.cos(a - math.pi / 2), math.sin(a - math.pi / 2)]), end]
    return np.array([*out, out[0]])


def offset_rings(metres: float, steps: int = 8):
    """Column function: the offset ring of a line (a point as a line of one), in local metres around the line's middle, as a polygon of one ring."""

    def one(line):
        xy = np.array([(p["x"], p["y"]) for p in line], float).reshape(-1, 2)
        if not len(xy):
            return []
        mid = (xy.min(0) + xy.max(0)) / 2
        scale = kernels.DEGREE_M * np.array([math.cos(math.radians(mid[1])), 1.0])
        ring = offset_ring((xy - mid) * scale, metres, steps) / scale + mid
        return [[{"x": float(x), "y": float(y)} for x, y in ring]]

    return F.pandas_udf(lambda s: s.map(lambda v: None if v is None else one(v)), kernels.POLYGON)


def buffer_edges(lines: DataFrame, key: list[str], metres: float, steps: int = 8, line: str = "line", grid: float = GRID) -> DataFrame:
    """The edges of all lines' offset rings, which run so that the buffer lies to the left."""
    shapes = lines.select(*key, F.array(offset_rings(metres, steps)(line)).alias("multi"))
    return edges_of(shapes, key, "multi", 0, grid, turn=False)


def buffers(lines: DataFrame, key: list[str], metres: float, steps: int = 8, line: str = "line", grid: float = GRID, cell: int | None = None) -> DataFrame:
    """The boundary of the union of each key's lines' buffers. Null and empty lines have none; a line of one point gives a disc."""
    return boundary(buffer_edges(lines, key, metres, steps, line, grid), key, positive, cell)


def dilate(shapes: DataFrame, key: list[str], metres: float, steps: int = 8, multi: str = "multi", grid: float = GRID, cell: int | None = None) -> DataFrame:
    """The boundary of each key's polygons grown by a distance: themselves and the buffers of their rings. Holes shrink or close."""
    around = shapes.select(*key, F.explode(F.flatten(multi)).alias("line"))
    return boundary(edges_of(shapes, key, multi, 0, grid).unionByName(buffer_edges(around, key, metres, steps, "line", grid)), key, positive, cell)
