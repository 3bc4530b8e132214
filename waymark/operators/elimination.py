"""Elimination: which part of a play area, and of each station's zone, is left after answered questions.

Every answer is a predicate on points. The play area is cut into cells (centre, area); each question adds a boolean column
``hit`` to each cell it constrains. A cell is eligible if all required constraints hold and no excluded one does:

* a question that yields no constraint at all leaves everything eligible (empty is not false);
* several features of one *separate* constraint family are constraints of their own; a *whole* family is one constraint that
  holds if any of its features does.

Predicate form is exact for discs, half-planes and nearest-candidate cells; the only error is the cell size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions.geo import DEGREE_M

#: Families in order, whether their features are constraints of their own, and the least travel of a thermometer.
FAMILIES = {"zone": "whole", "radar": "separate", "matching": "separate", "tentacles": "separate", "measuring": "separate", "thermometer": "separate", "transit": "whole"}
MIN_TRAVEL_M = 100.0


def cell_grid(spark: SparkSession, west: float, south: float, east: float, north: float, steps: int) -> DataFrame:
    """cell, lon, lat (centre), m2: ``steps`` x ``steps`` cells over a box; rows are made in parallel."""
    dx, dy = (east - west) / steps, (north - south) / steps
    g = spark.range(steps * steps).withColumnRenamed("id", "cell")
    g = g.withColumn("lon", F.lit(west) + (F.col("cell") % steps + 0.5) * dx)
    g = g.withColumn("lat", F.lit(south) + (F.floor(F.col("cell") / steps) + 0.5) * dy)
    return g.withColumn("m2", F.lit(dx * dy * DEGREE_M * DEGREE_M) * F.cos(F.radians("lat")))


def radar_holds(lon: str, lat: str, clon: str, clat: str, metres: str) -> Column:
    return geo.haversine_m(lon, lat, clon, clat) <= F.col(metres)


def thermometer_holds(lon: str, lat: str, lon1: str, lat1: str, lon2: str, lat2: str, answer: Column) -> Column:
    """Hotter: on the second point's side. Colder: on the first's. Null (no constraint) below the least travel."""
    side = geo.toward_second(lon, lat, lon1, lat1, lon2, lat2)
    far = geo.haversine_m(lon1, lat1, lon2, lat2) >= MIN_TRAVEL_M
    return F.when(far, F.when(answer == "hotter", side >= 0).otherwise(side <= 0))


def eligible(cells: DataFrame, tests: DataFrame) -> DataFrame:
    """cells with ``eligible``. tests: (cell, constraint, required, hit), a row a cell, constraint and feature.

    Features of one constraint are joined by or; a cell without any test stays eligible.
    """
    by = tests.groupBy("cell", "constraint").agg(F.bool_or("hit").alias("hit"), F.bool_or("required").alias("required"))
    by = by.groupBy("cell").agg(F.bool_and(F.col("hit") == F.col("required")).alias("ok"))
    return cells.join(by, "cell", "left").select(*cells.columns, F.coalesce("ok", F.lit(True)).alias("eligible"))


def contributions(tests: DataFrame, cells: DataFrame, zone: Column) -> DataFrame:
    """What each question takes away in its order: ord, before_m2, after_m2, percent of the zone, rounded and kept in 0..100.

    tests: (cell, ord, holds), one row a cell and question; a null ``holds`` constrains nothing. A running conjunction over
    ``ord`` gives each prefix's eligible cells; partitions are cells, so the window spreads.
    """
    w = Window.partitionBy("cell").orderBy("ord")
    run = F.min(F.coalesce("holds", F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    t = tests.withColumn("after", run)
    t = t.withColumn("before", F.coalesce(F.lag("after").over(w), F.lit(1)))
    t = t.join(cells.select("cell", "m2", zone.alias("in_zone")), "cell").filter("in_zone")
    out = t.groupBy("ord").agg(F.sum(F.col("m2") * F.col("before")).alias("before_m2"), F.sum(F.col("m2") * F.col("after")).alias("after_m2"), F.sum("m2").alias("zone_m2"))
    share = geo.js_round((F.col("before_m2") - F.col("after_m2")) * 100 / F.col("zone_m2"))
    return out.select("ord", "before_m2", "after_m2", F.when(F.col("zone_m2") > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), share))).otherwise(0.0).cast("int").alias("percent"))


def zone_percent(eligible_m2: Column, zone_m2: Column) -> Column:
    """How much of the zone is gone: 0..100; 0 for an empty zone."""
    return F.when(zone_m2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), geo.js_round((1 - eligible_m2 / zone_m2) * 100)))).otherwise(0.0).cast("int")


def station_areas(stations: DataFrame, cells: DataFrame, metres: float) -> DataFrame:
    """station, zone_m2, left_m2, fraction: what is eligible within each station's radius. cells: lon, lat, m2, eligible."""
    from waymark.operators.spatial_join import within_distance

    right = cells.select(F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"), "m2", "eligible")
    near = within_distance(stations.select("station", "lon", "lat"), right, metres)
    out = near.groupBy("station").agg(F.sum("m2").alias("zone_m2"), F.sum(F.when(F.col("eligible"), F.col("m2")).otherwise(0.0)).alias("left_m2"))
    return out.withColumn("fraction", F.col("left_m2") / F.col("zone_m2"))
