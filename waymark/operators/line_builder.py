"""Lines from relations, end to end: members resolved to stations, stop order mended, tracks chained, stations attached.

One job over four tables. Every primary relation gives a row, with the reason where no line comes of it:

1. a route with a master belongs to the master's line, any other route is its own line's only variant;
2. stop members become stations by id, else by place where the member's place is known, else by name;
3. a variant's stops take the order that an override gives, or are repaired where gaps are implausible;
4. the variants' ways, each once, are chained and simplified; lines of tracks, and lines with fewer than two stations, take
   the stations along them;
5. a line needs two stations, and a geometry of two points.

Joins go by ids and by cells; what one task gathers is a variant's stops or the ways of a line that share ends.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import kernels
from waymark.operators.sequences import _gaps, repair_order, stitch_ways
from waymark.operators.spatial_join import points_along_lines, within_distance
from waymark.operators.transit import KIND_PENALTY_M, OTHER_PENALTY_M, route_masters
from waymark.session import save

#: Roles of stop members, and kinds of routes that are tracks rather than services.
STOP_ROLES = ("stop", "station", "stop_entry_only", "stop_exit_only")
TRACKS = ("railway", "tracks")


def variants_of(routes: DataFrame, masters: DataFrame) -> DataFrame:
    """(line, variant, mastered): routes by the line that they are variants of. routes: relation; masters: relation, members.

    A route in several masters belongs to the smallest. A master without any of the routes has one row, whose variant is null.
    """
    m = masters.select(F.col("relation").alias("master"), "members")
    own = route_masters(routes.select(F.col("relation").alias("route")), m)
    got = own.select(F.coalesce("master", "route").alias("line"), F.col("route").alias("variant"), F.col("has_master").alias("mastered"))
    bare = masters.select(F.col("relation").alias("line")).join(got.select("line").distinct(), "line", "left_anti")
    return got.unionByName(bare.select("line", F.lit(None).cast(got.schema["variant"].dataType).alias("variant"), F.lit(True).alias("mastered")))


def resolve_members(members: DataFrame, stations: DataFrame, reach_m: float = 300.0) -> DataFrame:
    """Stop members (variant, seq) with station, how (id, place, name or null), ambiguous and weak.

    members: variant, seq, ref, name_key, lon, lat. stations: station, name_key (null: none), kind, s_lon, s_lat. A place takes
    the station with the smallest distance and kind's penalty, closer than ``reach_m``; the match is ambiguous if the next best is within
    a tenth of it, and weak beyond four fifths of the reach. Members whose place is known are not looked up by name.
    """
    m = save(members.select("variant", "seq", "ref", "name_key", "lon", "lat"))
    by_id = m.join(stations.select(F.col("station").alias("ref"), F.col("station").alias("by_id")).distinct(), "ref", "left_semi").select("variant", "seq", F.col("ref").alias("by_id"))
    rest = m.join(by_id, ["variant", "seq"], "left_anti")
    placed = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    named = stations.filter("name_key IS NOT NULL")
    near = within_distance(rest.filter(placed).select("variant", "seq", "lon", "lat"), named.select("station", "kind", "s_lon", "s_lat"), reach_m, right_at=("s_lon", "s_lat")).filter(F.col("m") < reach_m)
    penalty = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in KIND_PENALTY_M.items()), F.lit(OTHER_PENALTY_M))
    near = near.withColumn("e", F.round(F.col("m") + penalty, 6))
    order = Window.partitionBy("variant", "seq").orderBy("e", "station")
    near = near.withColumn("n", F.row_number().over(order)).withColumn("second", F.lead("e").over(order)).filter("n = 1")
    near = near.select("variant", "seq", F.col("station").alias("by_place"), F.coalesce(F.col("second") <= F.col("e") * 1.1, F.lit(False)).alias("ambiguous"), (F.col("m") > reach_m * 0.8).alias("weak"))
    by_name = rest.filter(~placed).join(named.groupBy("name_key").agg(F.min("station").alias("by_name")), "name_key").select("variant", "seq", "by_name")
    out = m.join(by_id, ["variant", "seq"], "left").join(near, ["variant", "seq"], "left").join(by_name, ["variant", "seq"], "left")
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_place").isNotNull(), "place").when(F.col("by_name").isNotNull(), "name")
    no = F.lit(False)
    return out.select("variant", "seq", F.coalesce("by_id", "by_place", "by_name").alias("station"), how.alias("how"), F.coalesce("ambiguous", no).alias("ambiguous"), F.coalesce("weak", no).alias("weak"))


def ordered_stops(stops: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(variant, seq, station, jumps, moved): a variant's stops in their final order.

    stops: variant, seq, station, lon, lat. overrides: variant, stop_order (stations that come first, in this order; null: none), quiet
    (nothing is repaired or counted). Without an override, repeats in a row go and up to three stops move where that leaves no implausible gap;
    jumps counts the gaps found before, moved says whether the order was repaired.
    """
    s = stops.select("variant", "seq", "station", "lon", "lat")
    if overrides is not None:
        s = s.join(overrides.select("variant", "stop_order", "quiet"), "variant", "left")
    else:
        s = s.withColumn("stop_order", F.lit(None).cast(f"array<{stops.schema['station'].dataType.simpleString()}>")).withColumn("quiet", F.lit(False))
    stop = F.struct("seq", "station", "lon", "lat")
    g = s.groupBy("variant").agg(F.array_sort(F.collect_list(stop)).alias("stops"), F.first("stop_order").alias("wish"), F.first("quiet").alias("quiet"))
    part = lambda name: F.transform("stops", lambda x: x[name])
    # places of equal stations have equal numbers: where each one first stands, in the stops and in the wish
    number = F.transform(part("station"), lambda x: F.array_position(part("station"), x))
    rank = F.transform(part("station"), lambda x: F.coalesce(F.array_position("wish", x), F.lit(0)))
    g = g.withColumn("o", _order(number, rank, part("lon"), part("lat"), F.col("wish").isNotNull(), F.coalesce("quiet", F.lit(False))))
    return g.select("variant", F.posexplode("o.order").alias("seq", "i"), "stops", "o.jumps", "o.moved").select("variant", "seq", F.get("stops", F.col("i"))["station"].alias("station"), "jumps", "moved")


@F.pandas_udf(T.StructType([T.StructField("order", T.ArrayType(T.IntegerType())), T.StructField("jumps", T.IntegerType()), T.StructField("moved", T.BooleanType())]))
def _order(number: pd.Series, rank: pd.Series, lon: pd.Series, lat: pd.Series, wished: pd.Series, quiet: pd.Series) -> pd.DataFrame:
    """Which stops stay and in what order. rank: from 1 in the wish, 0 outside it."""
    out = []
    for n, r, x, y, w, q in zip(number, rank, lon, lat, wished, quiet, strict=True):
        order, n = np.arange(len(n)), np.asarray(n)
        if w:
            first = np.where(np.asarray(r) > 0, r, len(order) + np.max(r))
            order = np.argsort(first, kind="stable")
            seen: set[int] = set()
            order = np.array([k for k in order if r[k] == 0 or not (n[k] in seen or seen.add(n[k]))])
        single = order[np.append(True, np.diff(n[order]) != 0)]
        jumps, moved = 0, False
        if len(single) >= 3 and not q:
            xy = np.column_stack([np.asarray(x, float), np.asarray(y, float)])[single]
            gaps, limit = _gaps(xy)
            jumps = int((gaps > limit).sum())
            if jumps and not w:
                mended = repair_order(xy)
                if moved := bool((mended != np.arange(len(mended))).any()):
                    order = single[mended]
        out.append((order.tolist(), jumps, moved))
    return pd.DataFrame(out, columns=["order", "jumps", "moved"])


def _first(columns: list[Column], order: Column, name: str) -> Column:
    return F.min_by(F.coalesce(*columns), F.when(F.coalesce(*columns).isNotNull(), order)).alias(name)


def build_lines(
    routes: DataFrame, masters: DataFrame, members: DataFrame, stations: DataFrame, ways: DataFrame | None = None, overrides: DataFrame | None = None,
    cluster_m: float = 150.0, attach_m: float = 120.0, simplify_m: float = 11.0,
) -> DataFrame:
    """A row a primary relation: line, mastered, name, operator, stations, geometry, source, unresolved, ambiguous, weak, jumps, repaired, reason.

    routes: relation, tags (map); masters: relation, tags, members (array of routes). members: relation, seq, type (node or
    way), ref, role, name_key, lon, lat; unique by relation and seq. stations: station, name_key, kind, s_lon, s_lat; unique. ways: way, line.
    stations lists a line's stations: resolved stops by variant and order, then attached ones along the track. geometry is
    the chained ways (source "ways"), else a line a variant through its stops ("stops"). reason is null for a line, else "no variants",
    "too few stations" or "no geometry". Relations without members are too few stations; a null name falls back to the ref.
    """
    v = save(variants_of(routes, masters))
    tags = routes.select("relation", "tags").unionByName(masters.select("relation", "tags"))
    tag = lambda k: F.nullif(F.try_element_at("tags", F.lit(k)), F.lit(""))
    facts = tags.select("relation", F.coalesce(tag("name"), tag("ref")).alias("name"), tag("operator").alias("operator"), tag("network").alias("network"), F.coalesce(tag("route_master"), tag("route"), tag("construction:route")).alias("route"))
    primary = v.groupBy("line").agg(F.bool_or("mastered").alias("mastered"), F.count("variant").alias("variants"))
    spoken = v.join(facts.select(F.col("relation").alias("variant"), "operator"), "variant").groupBy("line").agg(_first([F.col("operator")], F.col("variant"), "variant_operator"))
    primary = primary.join(facts.withColumnRenamed("relation", "line"), "line").join(spoken, "line", "left")
    operator = F.when(F.col("operator").isNull() | (F.col("operator") == F.coalesce("network", F.lit(""))), F.coalesce("variant_operator", "operator", "network")).otherwise(F.col("operator"))
    primary = primary.select("line", "mastered", "variants", F.coalesce("name", F.concat(F.lit("Line "), F.col("line").cast("string"))).alias("name"), operator.alias("operator"), "route")

    mine = members.join(v.filter("variant IS NOT NULL").select("line", F.col("variant").alias("relation")), "relation")
    stops = mine.filter((F.col("type") == "node") & F.col("role").isin(*STOP_ROLES)).withColumnRenamed("relation", "variant")
    found = save(resolve_members(stops, stations, 2 * cluster_m))
    at = stations.select("station", "s_lon", "s_lat")
    final = save(ordered_stops(found.filter("station IS NOT NULL").join(at, "station").select("variant", "seq", "station", F.col("s_lon").alias("lon"), F.col("s_lat").alias("lat")), overrides).join(v.select("line", "variant"), "variant"))
    counts = found.join(v.select("line", "variant"), "variant").groupBy("line").agg(*(F.count_if(c).alias(n) for c, n in ((F.col("station").isNull(), "unresolved"), (F.col("ambiguous"), "ambiguous"), (F.col("weak"), "weak"))))
    mended = final.select("line", "variant", "jumps", "moved").distinct().groupBy("line").agg(F.sum("jumps").cast("int").alias("jumps"), F.count_if("moved").cast("int").alias("repaired"))
    known = save(final.groupBy("line", "station").agg(F.min(F.struct("variant", "seq")).alias("place")))

    order = Window.partitionBy("variant").orderBy("seq")
    path = final.join(at, "station").withColumn("same", (F.lag("s_lon").over(order) == F.col("s_lon")) & (F.lag("s_lat").over(order) == F.col("s_lat"))).filter(~F.coalesce("same", F.lit(False)))
    points = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("s_lon").alias("x"), F.col("s_lat").alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    branches = path.groupBy("line", "variant").agg(points.alias("branch")).filter(F.size("branch") >= 2)
    shape = branches.groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("variant", "branch"))), lambda b: b["branch"]).alias("by_stops"))

    every = known.select("line", "station", F.lit(0).alias("late"), "place")
    tracks = None
    if ways is not None:
        carried = mine.filter(F.col("type") == "way").groupBy("line", F.col("ref").alias("way")).agg(F.min(F.struct("relation", "seq")).alias("first"))
        carried = carried.withColumn("ord", F.row_number().over(Window.partitionBy("line").orderBy("first", "way")))
        chained = stitch_ways(carried.join(ways.select("way", F.col("line").alias("track")), "way").select(F.col("line").alias("relation"), "ord", F.col("track").alias("line")))
        chained = save(chained.withColumn("line", kernels.simplify_m(simplify_m)("line") if simplify_m > 0 else F.col("line")))
        tracks = chained.groupBy(F.col("relation").alias("line")).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", F.col("line").alias("l")))), lambda p: p["l"]).alias("by_ways"))
        some = known.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
        wants = primary.join(some, "line", "left").filter(F.col("route").isin(*TRACKS) | (F.coalesce("n", F.lit(0)) < 2)).select(F.col("line").alias("relation"))
        along = chained.join(wants, "relation", "left_semi").select(F.struct(F.col("relation").alias("of"), "part").alias("piece"), "line")
        near = points_along_lines(stations.select("station", F.col("s_lon").alias("lon"), F.col("s_lat").alias("lat")), along, attach_m, "station", "piece")
        near = near.select(F.col("piece.of").alias("line"), "station", F.struct("piece.part", F.col("place").alias("nth")).alias("p")).groupBy("line", "station").agg(F.min("p").alias("p"))
        near = near.join(known.select("line", "station"), ["line", "station"], "left_anti")
        null_place = F.lit(None).cast(known.schema["place"].dataType)
        every = every.withColumn("p", F.lit(None).cast(near.schema["p"].dataType)).unionByName(near.select("line", "station", F.lit(1).alias("late"), null_place.alias("place"), "p"))
    else:
        every = every.withColumn("p", F.lit(None).cast("int"))
    listed = every.groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("late", "place", "p", "station"))), lambda s: s["station"]).alias("stations"))

    out = primary.join(listed, "line", "left").join(shape, "line", "left").join(counts, "line", "left").join(mended, "line", "left")
    out = out.join(tracks, "line", "left") if tracks is not None else out.withColumn("by_ways", F.lit(None).cast(out.schema["by_stops"].dataType))
    none = F.array().cast(out.schema["stations"].dataType)
    out = out.withColumn("stations", F.coalesce("stations", none)).withColumn("geometry", F.coalesce("by_ways", "by_stops"))
    source = F.when(F.col("by_ways").isNotNull(), "ways").when(F.col("by_stops").isNotNull(), "stops")
    reason = F.when(F.col("variants") == 0, "no variants").when(F.size("stations") < 2, "too few stations").when(F.col("geometry").isNull(), "no geometry")
    zero = lambda k: F.coalesce(k, F.lit(0)).cast("int").alias(k)
    return out.select("line", "mastered", "name", "operator", "stations", "geometry", source.alias("source"), *(zero(k) for k in ("unresolved", "ambiguous", "weak", "jumps", "repaired")), reason.alias("reason"))
