"""Question families as constraints on cells: one row a cell, question and feature, ready for ``elimination.eligible``.

Inputs are tables: questions (ord, type, answer, lon, lat, distance, lon2, lat2, category, selected, line), cells (cell, lon,
lat), candidates (poi, category, name_length, r_lon, r_lat) and stations (station, route_ids, r_lon, r_lat). Questions of one
game are few and broadcast; cells, candidates and stations meet through cell joins.

A question that is unanswered, too short a walk, or measured from a spot on its target yields no row, which constrains nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators.elimination import MIN_TRAVEL_M
from waymark.operators.spatial_join import nearest_anywhere, nearest_in_plane, within_distance

COLUMNS = ("cell", "constraint", "required", "hit")
#: Answers that require their region; their opposites exclude it.
REQUIRE, EXCLUDE = ("positive", "hotter", "colder", "closer"), ("negative", "further")


def _answered(questions: DataFrame, kind: str) -> DataFrame:
    q = questions.filter(F.col("type") == kind).withColumn("required", F.col("answer").isin(*REQUIRE))
    return q.filter(F.col("required") | F.col("answer").isin(*EXCLUDE))


def _rows(df: DataFrame, hit: Column) -> DataFrame:
    return df.select("cell", F.concat_ws(":", F.col("type"), F.col("ord")).alias("constraint"), "required", F.coalesce(hit, F.lit(False)).alias("hit"))


def _each(cells: DataFrame, questions: DataFrame) -> DataFrame:
    """Every cell with each of a game's questions; questions are broadcast."""
    return cells.select("cell", F.col("lon").alias("x"), F.col("lat").alias("y")).crossJoin(F.broadcast(questions))


def radar(cells: DataFrame, questions: DataFrame) -> DataFrame:
    """Within the distance of the centre."""
    return _rows(_each(cells, _answered(questions, "radar")), geo.haversine_m("x", "y", "lon", "lat") <= F.col("distance"))


def thermometer(cells: DataFrame, questions: DataFrame) -> DataFrame:
    """On the second point's side if hotter, on the first's if colder; both are required regions."""
    q = _answered(questions, "thermometer").filter(geo.haversine_m("lon", "lat", "lon2", "lat2") >= MIN_TRAVEL_M)
    side = geo.toward_second("x", "y", "lon", "lat", "lon2", "lat2")
    return _rows(_each(cells, q), F.when(F.col("answer") == "hotter", side >= 0).otherwise(side <= 0))


def matching(cells: DataFrame, questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Cells whose nearest candidate, in plain degrees, is the selected one; for name lengths, one with a name as long."""
    q = _answered(questions, "matching").filter(F.col("selected").isNotNull())
    kinds = [r["category"] for r in q.select("category").distinct().collect()]  # one entry a question at most
    out = None
    for kind in kinds:
        mine = candidates.filter(F.col("category") == kind)
        near = nearest_in_plane(cells, mine, ["cell"], "poi")
        near = near.join(mine.select("poi", "name_length"), "poi")
        wanted = mine.select(F.col("poi").alias("selected"), F.col("name_length").alias("wanted"))
        asked = q.filter(F.col("category") == kind).join(wanted, "selected").select("ord", "type", "required", "selected", "wanted")
        both = near.crossJoin(F.broadcast(asked))
        hit = F.col("name_length") == F.col("wanted") if kind == "station-name-length" else F.col("poi") == F.col("selected")
        rows = _rows(both, hit)
        out = rows if out is None else out.union(rows)
    return out if out is not None else _none(cells)


def tentacles(cells: DataFrame, questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Of the candidates within the radius: cells within it whose nearest one is selected; a no excludes the whole disc."""
    q = _answered(questions, "tentacles")
    each = candidates.join(F.broadcast(q.select("ord", "category", "lon", "lat", "distance")), "category")
    inside = each.filter(geo.haversine_m("r_lon", "r_lat", "lon", "lat") <= F.col("distance")).select("ord", "poi", "r_lon", "r_lat")
    disc = _each(cells, q.select("ord", "type", "required", "selected", "lon", "lat", "distance")).withColumn("in", geo.haversine_m("x", "y", "lon", "lat") <= F.col("distance"))
    disc = disc.join(inside.select("ord").distinct(), "ord", "left_semi")  # a disc without candidates constrains nothing
    d2 = F.pow(F.col("x") - F.col("r_lon"), 2) + F.pow(F.col("y") - F.col("r_lat"), 2)
    near = disc.filter("in").join(F.broadcast(inside), "ord").groupBy("cell", "ord").agg(F.min_by("poi", F.struct(F.round(d2, 14), F.col("poi"))).alias("poi"))
    both = disc.join(near, ["cell", "ord"], "left")
    return _rows(both, F.when(F.col("required"), F.col("poi") == F.col("selected")).otherwise(F.col("in")))


def measuring(cells: DataFrame, questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Cells at least as near to the category as the seeker is."""
    q = _answered(questions, "measuring")
    out = None
    for kind in [r["category"] for r in q.select("category").distinct().collect()]:
        mine = candidates.filter(F.col("category") == kind).select("poi", "r_lon", "r_lat")
        seekers = nearest_anywhere(q.filter(F.col("category") == kind).select("ord", "lon", "lat"), mine, ["ord"], F.col("poi"), tie=F.col("poi"))
        asked = q.select("ord", "type", "required").join(seekers.select("ord", F.col("m").alias("d")), "ord").filter("d > 0")
        near = nearest_anywhere(cells.select("cell", "lon", "lat"), mine, ["cell"], F.col("poi"), tie=F.col("poi"))
        rows = _rows(near.crossJoin(F.broadcast(asked)), F.col("m") <= F.col("d"))
        out = rows if out is None else out.union(rows)
    return out if out is not None else _none(cells)


def transit_line(cells: DataFrame, questions: DataFrame, stations: DataFrame, radius_m: float) -> DataFrame:
    """Zones of the stations on a line. Only the first yes and the first no of a game count."""
    q = _answered(questions, "transit-line").filter(F.col("line").isNotNull())
    q = q.withColumn("n", F.row_number().over(Window.partitionBy("required").orderBy("ord"))).filter("n = 1")
    near = within_distance(cells.select("cell", "lon", "lat"), stations.select("route_ids", "r_lon", "r_lat"), radius_m)
    served = near.select("cell", F.explode("route_ids").alias("line")).distinct().withColumn("served", F.lit(True))
    both = _each(cells, q.select("ord", "type", "required", "line")).join(served, ["cell", "line"], "left")
    return _rows(both, F.col("served"))


def zone(cells: DataFrame, stations: DataFrame, radius_m: float) -> DataFrame:
    """The hiding zone, one required constraint: within the radius of any station."""
    near = within_distance(cells.select("cell", "lon", "lat"), stations.select("r_lon", "r_lat"), radius_m).select("cell").distinct().withColumn("near", F.lit(True))
    return cells.join(near, "cell", "left").select("cell", F.lit("zone").alias("constraint"), F.lit(True).alias("required"), F.coalesce("near", F.lit(False)).alias("hit"))


def _none(cells: DataFrame) -> DataFrame:
    return cells.limit(0).select("cell", F.lit("").alias("constraint"), F.lit(True).alias("required"), F.lit(True).alias("hit"))


def constraints(cells: DataFrame, questions: DataFrame, candidates: DataFrame, stations: DataFrame, radius_m: float) -> DataFrame:
    """All families in their order, after the zone. Families without questions cost nothing."""
    kinds = {r["type"] for r in questions.select("type").distinct().collect()}
    parts = [zone(cells, stations, radius_m)]
    parts += [radar(cells, questions)] if "radar" in kinds else []
    parts += [matching(cells, questions, candidates)] if "matching" in kinds else []
    parts += [tentacles(cells, questions, candidates)] if "tentacles" in kinds else []
    parts += [measuring(cells, questions, candidates)] if "measuring" in kinds else []
    parts += [thermometer(cells, questions)] if "thermometer" in kinds else []
    parts += [transit_line(cells, questions, stations, radius_m)] if "transit-line" in kinds else []
    out = parts[0].select(*COLUMNS)
    for p in parts[1:]:
        out = out.union(p.select(*COLUMNS))
    return out
