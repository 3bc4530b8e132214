"""Joins by distance, nearest neighbours, boxes and containment, as equi-joins on grid cells.

Catalyst plans an equi-join well and a distance condition badly, so both sides get cell columns: one side its own cell, the
other a row for each cell within reach. What shares a cell is then checked exactly. Both sides shuffle by cell (or Spark
broadcasts the smaller, by its own size rule), so cost follows the number of near pairs, not the product of the tables.
Cells hold a bounded area; a crowded cell is one key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo, rings
from waymark.functions.geo import DEGREE_M, c
from waymark.session import save


#: Metres up to which nearest rows are looked for by radius.
FAR_M = 200_000.0
#: Degrees of latitude beyond which cells don't part longitudes.
POLAR = 88.0


def cells(df: DataFrame, lon: str, lat: str, degrees: float, dx: Column | None = None, dy: Column | None = None) -> DataFrame:
    """Adds cell_x, cell_y: the point's own cell, or a row for each cell within (dx, dy) degrees of it."""
    at = lambda v: F.floor(v / degrees).cast("long")
    if dx is None:
        return df.withColumn("cell_x", at(c(lon))).withColumn("cell_y", at(c(lat)))
    df = df.withColumn("cell_x", F.explode(F.sequence(at(c(lon) - dx), at(c(lon) + dx))))
    return df.withColumn("cell_y", F.explode(F.sequence(at(c(lat) - dy), at(c(lat) + dy))))


def box_cells(df: DataFrame, box: Column, degrees: float) -> DataFrame:
    """A row for each cell that a box touches."""
    at = lambda v: F.floor(v / degrees).cast("long")
    df = df.withColumn("cell_x", F.explode(F.sequence(at(box["w"]), at(box["e"]))))
    return df.withColumn("cell_y", F.explode(F.sequence(at(box["s"]), at(box["n"]))))


def reach(metres: float, lat: Column) -> tuple[Column, Column]:
    """Degrees of longitude and latitude within which all points ``metres`` away lie: near a pole, all longitudes."""
    dy = metres / DEGREE_M * 1.01
    far = F.abs(lat) + dy
    return F.when(far < 89, F.lit(dy) / F.cos(F.radians(far))).otherwise(F.lit(360.0)), F.lit(dy)


def segment_cells(df: DataFrame, degrees: float, pad_x: Column, pad_y: Column) -> DataFrame:
    """A row for each cell that comes within the pads of a segment (ax, ay, bx, by): column by column of cells, the rows that
    the part of the segment near that column reaches. A long segment gets cells by its length, not by its box."""
    at = lambda v: F.floor(v / degrees).cast("long")
    df = df.withColumn("cell_x", F.explode(F.sequence(at(F.least("ax", "bx") - pad_x), at(F.greatest("ax", "bx") + pad_x))))
    dx = F.nullif(F.col("bx") - F.col("ax"), F.lit(0.0))
    where = lambda x, whole: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce((x - F.col("ax")) / dx, F.lit(whole))))
    y = lambda t: F.col("ay") + t * (F.col("by") - F.col("ay"))
    y1, y2 = y(where(F.col("cell_x") * degrees - pad_x, 0.0)), y(where((F.col("cell_x") + 1) * degrees + pad_x, 1.0))
    return df.withColumn("cell_y", F.explode(F.sequence(at(F.least(y1, y2) - pad_y), at(F.greatest(y1, y2) + pad_y))))


def within_distance(left: DataFrame, right: DataFrame, metres: float, left_at: tuple[str, str] = ("lon", "lat"), right_at: tuple[str, str] = ("r_lon", "r_lat")) -> DataFrame:
    """All pairs at most ``metres`` apart (great circle), with their distance ``m``. Column names must not clash.

    Every left row reaches the cells within the radius. Rows of cells beyond POLAR degrees are one cell each, since there any
    longitude may be near.
    """
    cell = max(metres / DEGREE_M, 1e-6)
    at = lambda v: F.floor(v / cell).cast("long")
    dx, dy = reach(metres, c(left_at[1]))
    polar = F.abs((F.col("cell_y") + 0.5) * cell) > POLAR
    mine = left.withColumn("cell_y", F.explode(F.sequence(at(c(left_at[1]) - dy), at(c(left_at[1]) + dy))))
    mine = mine.withColumn("cell_x", F.explode(F.when(polar, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(at(c(left_at[0]) - dx), at(c(left_at[0]) + dx)))))
    other = right.withColumn("cell_y", at(c(right_at[1]))).withColumn("cell_x", F.when(polar, F.lit(0).cast("long")).otherwise(at(c(right_at[0]))))
    near = mine.join(other, ["cell_x", "cell_y"])
    near = near.withColumn("m", geo.haversine_m(*left_at, *right_at)).filter(F.col("m") <= metres)
    return near.drop("cell_x", "cell_y")


def nearest(left: DataFrame, right: DataFrame, k: int, metres: float, key: list[str], tie: list[str], left_at: tuple[str, str] = ("lon", "lat"), right_at: tuple[str, str] = ("r_lon", "r_lat")) -> DataFrame:
    """The ``k`` nearest right rows within a radius for each left key, ranked 1.. in ``rank``; ties by the columns ``tie``.

    Of right rows in one place the first k by the tie can count. The radius grows fourfold up to the whole one, for keys with
    fewer than k rows so far: whoever has k within a smaller one has its nearest. Work follows k, not how dense the rows lie.
    """
    if set(tie) <= set(right.columns):
        spot = Window.partitionBy(*right_at).orderBy(*tie)
        right = save(right.withColumn("__n", F.row_number().over(spot)).filter(F.col("__n") <= k).drop("__n"))
    todo, out = left, None
    for r in (metres / 64, metres / 16, metres / 4, metres):
        order = Window.partitionBy(*key)
        near = within_distance(todo, right, r, left_at, right_at).withColumn("rank", F.row_number().over(order.orderBy("m", *tie))).filter(F.col("rank") <= k)
        if r < metres:
            near = near.withColumn("__all", F.max("rank").over(order)).filter(F.col("__all") == k).drop("__all")
        near = save(near)
        out = near if out is None else out.unionByName(near)
        if r < metres:
            todo = save(todo.join(near.select(*key).distinct(), key, "left_anti").select(*left.columns))
    return out


def nearest_anywhere(left: DataFrame, right: DataFrame, key: list[str], payload: Column, left_at: tuple[str, str] = ("lon", "lat"), right_at: tuple[str, str] = ("r_lon", "r_lat"), tie: Column | None = None, first_m: float = 2000.0) -> DataFrame:
    """The nearest right row for each left key, however far: ``best`` (payload), ``m``; null if there is none at all.

    The radius grows fourfold round by round, each a join on cells of that size; rows that found something are done, as nothing
    outside the radius is nearer. From FAR_M on, bounds by coarse cells say which points to look at. Left rows in one place
    look once, and of right rows in one place the first by the tie is looked at.
    """
    ok = lambda df, at: df.filter(F.col(at[0]).isNotNull() & F.col(at[1]).isNotNull() & ~F.isnan(at[0]) & ~F.isnan(at[1]))
    at = list(left_at)
    rows = save(left.select(*key, *at).distinct())
    first = F.min_by(F.struct(payload.alias("best"), tie.alias("tie")), tie) if tie is not None else F.first(F.struct(payload.alias("best")))
    right = save(ok(right, right_at).groupBy(*right_at).agg(first.alias("__first")))
    todo, done, r = save(ok(rows, left_at).select(*at).distinct()), None, first_m
    order = F.struct("m", "__first.tie") if tie is not None else F.struct("m")
    while not todo.isEmpty() and r < 4e7:
        near = within_distance(todo, right, r, left_at, right_at) if r < FAR_M else _far(todo, right, [], left_at, right_at)
        found = save(near.groupBy(*at).agg(F.min_by("__first", order).alias("__first"), F.min("m").alias("m")))
        done = found if done is None else done.union(found)
        if r >= FAR_M:
            break
        todo, r = save(todo.join(found, at, "left_anti")), r * 4
    if done is None:
        done = todo.join(right.select("__first", F.lit(0.0).alias("m")).limit(0), F.lit(False), "left")
    order = F.when(F.col("m").isNotNull(), order)
    return rows.join(done, at, "left").groupBy(*key).agg(F.min_by("__first", order).alias("__first"), F.min("m").alias("m")).select(*key, F.col("__first.best").alias("best"), "m")


def _far(few: DataFrame, right: DataFrame, key: list[str], left_at: tuple[str, str], right_at: tuple[str, str]) -> DataFrame:
    """Pairs of rows that have nothing near with the right rows that can be their nearest.

    The right side's cells of a degree, at most 64,800 and so broadcast, bound distances from both sides: a cell's points lie
    within 79 km of its middle. Only points of cells that can hold the nearest are met.
    """
    at = lambda v: F.floor(v).cast("long")
    tiles = right.withColumn("cell_x", at(F.col(right_at[0]))).withColumn("cell_y", at(F.col(right_at[1])))
    centres = tiles.select("cell_x", "cell_y").distinct()
    bound = few.crossJoin(F.broadcast(centres)).withColumn("__d", geo.haversine_m(*left_at, F.col("cell_x") + 0.5, F.col("cell_y") + 0.5))
    bound = bound.withColumn("__least", F.min("__d").over(Window.partitionBy(*key, *left_at))).filter(F.col("__d") <= F.col("__least") + 2 * 79_000.0).drop("__d", "__least")
    return bound.join(tiles, ["cell_x", "cell_y"]).drop("cell_x", "cell_y").withColumn("m", geo.haversine_m(*left_at, *right_at))


def nearest_in_plane(left: DataFrame, right: DataFrame, key: list[str], payload: str, first_deg: float = 0.05, digits: int = 14) -> DataFrame:
    """The right row nearest in plain degrees for each left row, by widening squares; ties by the payload; null without a place, or without right rows.

    A square of half width d holds all points within d, so a hit counts once its distance is at most d.
    """
    todo, done, d = save(left.select(*key, "lon", "lat")), None, first_deg
    while not todo.isEmpty() and d < 720:
        near = cells(todo, "lon", "lat", d, F.lit(d), F.lit(d)).join(cells(right, "r_lon", "r_lat", d), ["cell_x", "cell_y"])
        d2 = F.round(F.pow(F.col("lon") - F.col("r_lon"), 2) + F.pow(F.col("lat") - F.col("r_lat"), 2), digits)
        found = save(near.filter(d2 <= d * d).groupBy(*key).agg(F.min_by(payload, F.struct(d2, F.col(payload))).alias(payload)))
        done = found if done is None else done.union(found)
        todo, d = save(todo.join(found, key, "left_anti")), d * 4
    keys = left.select(*key).distinct()
    if done is None:
        return keys.join(right.select(payload).limit(0), F.lit(False), "left")
    return keys.join(done, key, "left")


def points_in_polygons(points: DataFrame, polygons: DataFrame, degrees: float = 0.05, at: tuple[str, str] = ("lon", "lat"), multi: str = "multi") -> DataFrame:
    """All (point, polygon) pairs with the point inside. ``polygons`` has ``box`` and the multipolygon column."""
    tiled = box_cells(polygons, F.col("box"), degrees)
    both = cells(points, *at, degrees).join(tiled, ["cell_x", "cell_y"])
    both = both.filter(geo.box_has_point(F.col("box"), *at)).filter(rings.point_in_multipolygon(at[0], at[1], F.col(multi)))
    return both.drop("cell_x", "cell_y")


def first_polygon(points: DataFrame, polygons: DataFrame, key: list[str], order: list[Column], **how) -> DataFrame:
    """Each point's first polygon by ``order``; points in none are left out."""
    hits = points_in_polygons(points, polygons, **how)
    return hits.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def covering_box(points: DataFrame, boxes: DataFrame, key: list[str], tie: str, at: tuple[str, str] = ("lon", "lat"), degrees: float = 0.5) -> DataFrame:
    """The smallest box that holds each point, equal areas (to 12 decimals) by the tie. boxes: (box, tie); both sides meet by cell."""
    both = cells(points, *at, degrees).join(box_cells(boxes, F.col("box"), degrees), ["cell_x", "cell_y"]).filter(geo.box_has_point(F.col("box"), *at))
    return both.groupBy(*key).agg(F.min_by(F.col(tie), F.struct(F.round(geo.box_area(F.col("box")), 12), F.col(tie))).alias(tie))


def segments(lines: DataFrame, key: list[str], line: str = "line") -> DataFrame:
    """A row a segment: key, seg, ax, ay, bx, by."""
    pair = F.posexplode(F.arrays_zip(F.slice(F.col(line), 1, F.greatest(F.size(line) - 1, F.lit(0))).alias("a"), F.slice(F.col(line), 2, F.greatest(F.size(line) - 1, F.lit(0))).alias("b")))
    s = lines.filter(F.size(line) > 1).select(*key, pair.alias("seg", "p"))
    return s.select(*key, "seg", F.col("p.a.x").alias("ax"), F.col("p.a.y").alias("ay"), F.col("p.b.x").alias("bx"), F.col("p.b.y").alias("by"))


def points_along_lines(points: DataFrame, lines: DataFrame, metres: float, point_key: str, line_key: str, degrees: float = 0.02) -> DataFrame:
    """Points at most ``metres`` from a line: (line, point, m, seg, t), by nearest segment; ``place`` numbers them along it.

    Segments go to the cells that they pass within reach, so a long segment meets only points along it. Both sides are
    shuffled: Spark takes the tiles for as small as the lines that they come from, and would send them all to every task.
    """
    s = segments(lines, [line_key])
    tiles = segment_cells(s, degrees, *reach(metres, F.greatest(F.abs("ay"), F.abs("by"))))
    k = F.col("__k")
    both = cells(points.select(point_key, "lon", "lat", F.cos(F.radians("lat")).alias("__k")), "lon", "lat", degrees).join(tiles.hint("merge"), ["cell_x", "cell_y"])
    both = both.withColumn("t", geo.segment_fraction(F.col("lon") * k, F.col("lat"), F.col("ax") * k, F.col("ay"), F.col("bx") * k, F.col("by")))
    at_x, at_y = (F.col("a" + v) + F.col("t") * (F.col("b" + v) - F.col("a" + v)) for v in "xy")
    dx, dy = reach(metres, F.abs("lat"))
    both = both.filter((F.abs(at_y - F.col("lat")) <= dy) & (F.abs(at_x - F.col("lon")) <= dx))  # costs less than a distance
    both = both.withColumn("m", geo.point_segment_haversine_m("lon", "lat", "ax", "ay", "bx", "by")).filter(F.col("m") <= metres)
    near = both.groupBy(line_key, point_key).agg(F.min(F.struct("m", "seg", "t")).alias("x")).select(line_key, point_key, "x.*")
    return near.withColumn("place", F.row_number().over(Window.partitionBy(line_key).orderBy("seg", "t", point_key)))


def overlapping_boxes(boxes: DataFrame, key: str, degrees: float) -> DataFrame:
    """Pairs (a, b), a < b, whose boxes overlap or touch. Boxes meet in several cells; the cell of the overlap's lower left
    corner gives the pair."""
    t = box_cells(boxes.select(key, "box"), F.col("box"), degrees)
    other = t.select(F.col(key).alias("b"), F.col("box").alias("box_b"), "cell_x", "cell_y")
    both = t.withColumnRenamed(key, "a").join(other, ["cell_x", "cell_y"]).filter(F.col("a") < F.col("b"))
    corner = lambda side: F.floor(F.greatest(F.col("box")[side], F.col("box_b")[side]) / degrees)
    return both.filter(geo.boxes_meet(F.col("box"), F.col("box_b")) & (corner("w") == F.col("cell_x")) & (corner("s") == F.col("cell_y"))).select("a", "b")


def overlap_links(boxes: DataFrame, key: str, degrees: float) -> DataFrame:
    """Pairs (a, b) with the same connected components as all overlaps: equal boxes link to the smallest key among them, which
    alone meets other boxes."""
    firsts = boxes.groupBy("box").agg(F.min(key).alias("a"))
    equal = boxes.join(firsts, "box").filter(F.col(key) != F.col("a")).select("a", F.col(key).alias("b"))
    return equal.unionByName(overlapping_boxes(firsts.withColumnRenamed("a", key), key, degrees))
