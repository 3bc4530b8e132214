"""Queries: geodesy, boxes, units, rings, spatial joins, search and elimination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo, rings
from waymark.operators import elimination, equals, search, spatial_join
from waymark.operators.graph import connected_components
from waymark.plans.registry import LAT, LON, hav, pos, query
from waymark.session import lat_of, lon_of, pois, save, stations, table

CUSTOMERS = f"SELECT c_custkey AS k, c_mktsegment AS category, c_name AS name, {pos('c_custkey')} FROM customer"
POIS = f"SELECT c_custkey AS poi, c_mktsegment AS category, c_name AS name, {pos('c_custkey')} FROM customer"
STATIONS = f"SELECT s_suppkey AS station, s_nationkey::BIGINT AS operator, s_name AS name, {pos('s_suppkey')} FROM supplier"
BOX_SQL = "least(lon, lon2) AS w, least(lat, lat2) AS s, greatest(lon, lon2) AS e, greatest(lat, lat2) AS n"


def _r(col, n: int, name: str):
    return F.round(col, n).alias(name)


@query(f"""
WITH p AS ({CUSTOMERS}), q AS (SELECT *, k % 360 AS bearing, 100.3::DOUBLE + k % 5000 AS m FROM p)
SELECT k, round({hav('lon', 'lat', '139.5', '35.5')}, 3) AS m_to, round({hav('lon', 'lat', '139.5', '35.5', '6371.0')}, 6) AS km_to,
  round(degrees(radians(lon) + atan2(sin(radians(bearing)) * sin(m / 6371000) * cos(radians(lat)), cos(m / 6371000) - sin(radians(lat)) * (sin(radians(lat)) * cos(m / 6371000) + cos(radians(lat)) * sin(m / 6371000) * cos(radians(bearing))))), 6) AS to_lon,
  round(degrees(asin(sin(radians(lat)) * cos(m / 6371000) + cos(radians(lat)) * sin(m / 6371000) * cos(radians(bearing)))), 6) AS to_lat,
  '(' || printf('%.5f', lat) || ', ' || printf('%.5f', lon) || ')' AS shown, printf('%.7f', lon) || ',' || printf('%.7f', lat) AS node,
  floor(lon * 100000 + 0.5)::INT AS grid_x, floor(-lat * 100000 + 0.5)::INT AS grid_y, floor(lon * 1000000 + 0.5)::BIGINT AS micro_x,
  round(m / (111320 * cos(radians(lat))), 9) AS deg_lon, round(m / 111320, 9) AS deg_lat,
  round(degrees(m / 6371008.8 * 1.01), 9) AS circle_dy, round(degrees(asin(sin(m / 6371008.8 * 1.01) / cos(radians(lat)))), 9) AS circle_dx,
  CASE WHEN m < 1000 THEN printf('%d', floor(m + 0.5)::BIGINT) || ' meters' ELSE printf('%.1f', m / 1000) || ' km' END AS distance, round(m * 0.02 + 5, 6) AS tolerance
FROM q""")
def geodesy_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pois(spark, sf_dir).withColumn("bearing", F.col("poi") % 360).withColumn("m", F.lit(100.3) + F.col("poi") % 5000)
    x, y = geo.destination("lon", "lat", "bearing", "m")
    box = geo.circle_box("lon", "lat", "m")
    return p.select(
        F.col("poi").alias("k"), _r(geo.haversine_m("lon", "lat", 139.5, 35.5), 3, "m_to"), _r(geo.haversine_km("lon", "lat", 139.5, 35.5), 6, "km_to"),
        _r(x, 6, "to_lon"), _r(y, 6, "to_lat"), geo.format_coordinate("lon", "lat").alias("shown"), geo.node_key("lon", "lat").alias("node"),
        geo.quantize("lon").alias("grid_x"), geo.quantize(-F.col("lat")).alias("grid_y"), geo.quantize("lon", 1e6).cast("long").alias("micro_x"),
        _r(geo.lon_degrees("m", "lat"), 9, "deg_lon"), _r(geo.lat_degrees("m"), 9, "deg_lat"),
        _r(box["n"] - F.col("lat"), 9, "circle_dy"), _r(box["e"] - F.col("lon"), 9, "circle_dx"), geo.format_station_distance(F.col("m")).alias("distance"), _r(geo.box_tolerance_m("m"), 6, "tolerance"),
    )


@query(f"""
WITH p AS ({CUSTOMERS}), q AS (SELECT *, {LON.format('(k + 17)')} AS lon2, {LAT.format('(k + 17)')} AS lat2 FROM p), b AS (SELECT k, lon, lat, {BOX_SQL} FROM q),
c AS (SELECT *, greatest({', '.join(hav('139.5', '35.5', x, y) for x in 'we' for y in 'sn')}) AS far, greatest(0, least(e, 139.7) - greatest(w, 139.3)) * greatest(0, least(n, 35.7) - greatest(s, 35.3)) AS common FROM b)
SELECT k, w <= 139.7 AND e >= 139.3 AND s <= 35.7 AND n >= 35.3 AS meets, lon BETWEEN 139.3 AND 139.7 AND lat BETWEEN 35.3 AND 35.7 AS has_point,
  139.3 <= w AND 35.3 <= s AND 139.7 >= e AND 35.7 >= n AS inside, far <= 40000 AS covered, round(CASE WHEN (e - w) * (n - s) > 0 THEN common / ((e - w) * (n - s)) ELSE 0 END, 6) AS ratio,
  round((w + e) / 2, 6) AS mid_x, round(sqrt(pow((e - w) * 111320 * cos(radians((s + n) / 2)), 2) + pow((n - s) * 111320, 2)), 2) AS diagonal,
  round(greatest(abs(w - 139.3), abs(e - 139.7), abs(s - 35.3), abs(n - 35.7)), 6) AS moved, round(w - 0.25, 6) AS padded_w,
  round(w - 5000 / (111320 * cos(radians((s + n) / 2))), 8) AS window_w, {hav('lon', 'lat', '139.5', '35.5')} + 2000 <= 30000 AS circle_in, CASE WHEN k % 2 = 1 THEN 'imperial' ELSE 'metric' END AS units,
  {' OR '.join(f'(w <= {e} AND e >= {w} AND s <= {n} AND n >= {s})' for w, s, e, n in geo.JAPAN)} AS japan
FROM c""")
def box_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pois(spark, sf_dir).withColumn("k", F.col("poi") + 17)
    p = p.withColumn("lon2", lon_of("k")).withColumn("lat2", lat_of("k")).withColumn("b", geo.bbox(F.least("lon", "lon2"), F.least("lat", "lat2"), F.greatest("lon", "lon2"), F.greatest("lat", "lat2")))
    b, area = F.col("b"), geo.bbox(139.3, 35.3, 139.7, 35.7)
    return p.select(
        F.col("poi").alias("k"), geo.boxes_meet(b, area).alias("meets"), geo.box_has_point(area, "lon", "lat").alias("has_point"), geo.box_has_box(area, b).alias("inside"),
        geo.circle_covers_box(139.5, 35.5, 40000.0, b).alias("covered"), _r(geo.overlap_ratio(area, b), 6, "ratio"), _r(geo.box_centre(b)[0], 6, "mid_x"), _r(geo.box_diagonal_m(b), 2, "diagonal"),
        _r(geo.box_delta(b, area), 6, "moved"), _r(geo.pad_box(b, 0.25)["w"], 6, "padded_w"), _r(geo.window_box(b, 5000.0)["w"], 8, "window_w"),
        geo.circle_covers_circle(139.5, 35.5, 30000.0, "lon", "lat", 2000.0).alias("circle_in"), geo.default_units(F.when(F.col("poi") % 2 == 1, F.col("lon") - 236).otherwise(F.col("lon")), F.col("lat") + 5).alias("units"), geo.meets_any_box(b, geo.JAPAN).alias("japan"),
    )


@query("""
WITH q AS (SELECT p_partkey AS k, p_retailprice / 7 AS v, p_size, ['m', 'km', 'mi', 'ft'][(p_partkey % 4 + 1)::INT] AS unit FROM part)
SELECT k, round(CASE WHEN v > 0 THEN v * CASE unit WHEN 'm' THEN 1.0 WHEN 'km' THEN 1000.0 WHEN 'mi' THEN 1609.344 END END, 3) AS metres,
  CASE WHEN k % 5 = 0 THEN NULL ELSE round(p_size * 1000.0::DOUBLE, 3) END AS km_metres, printf('%d', p_size) AS whole
FROM q""")
def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_retailprice") / 7).alias("v"), "p_size", F.element_at(F.array(*map(F.lit, ("m", "km", "mi", "ft"))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("unit"))
    odd = F.when(F.col("k") % 5 == 0, F.lit("none")).otherwise(F.col("p_size").cast("string"))
    return p.select("k", _r(geo.to_metres(F.col("v").cast("string"), "unit"), 3, "metres"), _r(geo.to_metres(odd, F.lit("km")), 3, "km_metres"), geo.format_distance("p_size").alias("whole"))


@query(f"""
WITH p AS ({CUSTOMERS}), q AS (SELECT k, lon, lat, {LON.format('(k + 1)')} AS ax, {LAT.format('(k + 1)')} AS ay, {LON.format('(k + 2)')} AS bx, {LAT.format('(k + 2)')} AS b_y FROM p),
l AS (SELECT *, (ax - lon) * 111320 * cos(radians(lat)) AS x1, (ay - lat) * 111320 AS y1, (bx - lon) * 111320 * cos(radians(lat)) AS x2, (b_y - lat) * 111320 AS y2 FROM q),
t AS (SELECT *, greatest(0, least(1, -(x1 * (x2 - x1) + y1 * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS f FROM l),
x AS (SELECT *, (bx - ax) * (35.9 - 35.1) - (b_y - ay) * (139.9 - 139.1) AS den FROM t),
y AS (SELECT *, ((139.1 - ax) * (35.9 - 35.1) - (35.1 - ay) * (139.9 - 139.1)) / nullif(den, 0) AS ct, ((139.1 - ax) * (b_y - ay) - (35.1 - ay) * (bx - ax)) / nullif(den, 0) AS cu FROM x)
SELECT k, round(f, 6) AS fraction, round(sqrt(pow(x1 + f * (x2 - x1), 2) + pow(y1 + f * (y2 - y1), 2)), 2) AS metres,
  round(CASE WHEN ct > 1e-9 AND ct < 1 - 1e-9 AND cu > 1e-9 AND cu < 1 - 1e-9 THEN ct END, 6) AS crossing
FROM y""")
def segment_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pois(spark, sf_dir)
    for n, (x, y) in ((1, ("ax", "ay")), (2, ("bx", "by"))):
        p = p.withColumn("__k", F.col("poi") + n).withColumn(x, lon_of("__k")).withColumn(y, lat_of("__k"))
    a, b = geo.local_metres("ax", "ay", "lon", "lat"), geo.local_metres("bx", "by", "lon", "lat")
    zero = F.lit(0.0)
    return p.select(
        F.col("poi").alias("k"), _r(geo.segment_fraction(zero, zero, *a, *b), 6, "fraction"), _r(geo.point_segment_m("lon", "lat", "ax", "ay", "bx", "by"), 2, "metres"),
        _r(geo.segment_crossing("ax", "ay", "bx", "by", 139.1, 35.1, 139.9, 35.9), 6, "crossing"),
    )


@query(f"WITH s AS ({STATIONS}) SELECT station, round(lon, 7) AS lon, round(lat, 7) AS lat FROM s")
def projection_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stations(spark, sf_dir)
    x, y = geo.aeqd("lon", "lat", 139.5, 35.5)
    s = s.withColumn("x", x).withColumn("y", y)
    lon, lat = geo.aeqd_inverse("x", "y", 139.5, 35.5)
    return s.select("station", _r(lon, 7, "lon"), _r(lat, 7, "lat"))


RING_SQL = f"""
WITH s AS ({STATIONS}), k AS (SELECT *, unnest(range(0, 13)) AS i FROM s),
v AS (SELECT station, i, lon AS clon, lat AS clat, radians((i % 12) * -30.0::DOUBLE) AS b, 600.0::DOUBLE / 6371000 AS d FROM k),
w AS (SELECT *, degrees(asin(sin(radians(clat)) * cos(d) + cos(radians(clat)) * sin(d) * cos(b))) AS y FROM v),
r AS (SELECT *, degrees(radians(clon) + atan2(sin(b) * sin(d) * cos(radians(clat)), cos(d) - sin(radians(clat)) * sin(radians(y)))) AS x FROM w),
p AS (SELECT *, lead(x) OVER o AS x2, lead(y) OVER o AS y2 FROM r WINDOW o AS (PARTITION BY station ORDER BY i))"""


@query(f"""{RING_SQL}
SELECT station, count(*)::INT AS points, round(sum((x * y2 - x2 * y) / 2), 8) AS planar, round(abs(sum(radians(x2 - x) * (2 + sin(radians(y)) + sin(radians(y2))))) * 6378137.0 * 6378137.0 / 2, 1) AS m2,
  round(abs(sum((x * y2 - x2 * y) / 2)) * 111320.0 * 111320.0 * cos(radians(avg(y))), 0) AS flat_m2, round(sum({hav('x', 'y', 'x2', 'y2')}), 3) AS perimeter,
  round(min(x), 7) AS w, round(max(y), 7) AS n, station % 3 <> 0 AS holds_centre, 0.001 * (station % 12) * 111195 * cos(radians(any_value(clat))) < 600 AS holds_other, station % 5 <> 0 AS closed
FROM p GROUP BY station""")
def station_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations' 12-cornered discs, measured; a third have a hole at their centre, a fifth are tested unclosed."""
    s = stations(spark, sf_dir).withColumn("ring", geo.circle_ring("lon", "lat", 600.0, 12))
    s = s.withColumn("multi", F.array(F.array("ring"))).withColumn("box", rings.bounds(F.col("ring"))).withColumn("hole", geo.circle_ring("lon", "lat", 100.0, 12))
    s = s.withColumn("holed", F.array(F.when(F.col("station") % 3 == 0, F.array("ring", "hole")).otherwise(F.array("ring"))))
    s = s.withColumn("cut", F.array(F.array(F.when(F.col("station") % 5 == 0, F.slice("ring", 1, 12)).otherwise(F.col("ring"))))).withColumn("ok", rings.sanity(F.col("cut")))
    ring, multi = F.col("ring"), F.col("multi")
    return s.select(
        "station", rings.count_points(multi).alias("points"), _r(rings.planar_area(ring), 8, "planar"), _r(rings.multipolygon_area_m2(multi), 1, "m2"), _r(rings.equirect_area_m2(ring), 0, "flat_m2"),
        _r(rings.length_m(ring), 3, "perimeter"), _r(F.col("box.w"), 7, "w"), _r(F.col("box.n"), 7, "n"), rings.point_in_multipolygon("lon", "lat", F.col("holed")).alias("holds_centre"),
        rings.point_in_geometry(F.col("lon") + 0.001 * (F.col("station") % 12), F.col("lat"), F.lit("Polygon"), multi).alias("holds_other"), (F.col("ok.unclosed") == 0).alias("closed"),
    )


@query(f"""{RING_SQL}, g AS (SELECT station, i, floor(x * 100000 + 0.5)::BIGINT AS gx, floor(y * 100000 + 0.5)::BIGINT AS gy FROM r),
d AS (SELECT *, gx - coalesce(lag(gx) OVER o, 0) AS dx, gy - coalesce(lag(gy) OVER o, 0) AS dy FROM g WINDOW o AS (PARTITION BY station ORDER BY i))
SELECT station, '1,1,13,' || string_agg(dx || ',' || dy, ',' ORDER BY i) AS encoded, round(max(gx / 100000.0::DOUBLE), 5) AS max_x, round(min(gy / 100000.0::DOUBLE), 5) AS min_y FROM d GROUP BY station""")
def delta_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings on the integer grid as differences, and back."""
    s = stations(spark, sf_dir).withColumn("ring", geo.circle_ring("lon", "lat", 600.0, 12)).withColumn("multi", F.array(F.array("ring")))
    s = s.withColumn("code", rings.delta_encode(F.col("multi"))).withColumn("deltas", F.slice("code", 4, F.size("code")))
    s = s.withColumn("back", rings.delta_points(F.col("deltas")))
    return s.select("station", F.array_join(F.col("code").cast("array<string>"), ",").alias("encoded"), _r(rings.bounds(F.col("back"))["e"], 5, "max_x"), _r(rings.bounds(F.col("back"))["s"], 5, "min_y"))


# --- joins and search


@query(f"""
WITH s AS ({STATIONS}), p AS ({POIS}), d AS (SELECT station, poi, {hav('s.lon', 's.lat', 'p.lon', 'p.lat')} AS m FROM s, p),
r AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY m, poi) AS rank FROM d WHERE m <= 8000)
SELECT station, poi, round(m, 3) AS m, rank::INT AS rank FROM r WHERE rank <= 3""")
def nearest_pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 nearest points of interest within 8 km of each station."""
    p = pois(spark, sf_dir).select("poi", F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    return spatial_join.nearest(stations(spark, sf_dir), p, 3, 8000.0, ["station"], ["poi"]).select("station", "poi", _r(F.col("m"), 3, "m"), "rank")


@query(f"""
WITH p AS ({POIS}), q AS (SELECT *, {hav('lon', 'lat', '139.5', '35.5')} AS m FROM p)
SELECT category, poi, round(m, 3) AS m, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY m, poi) AS rank FROM q) WHERE rank <= 20""")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest candidates of each category around a point (top-k by category)."""
    return search.rank_by_distance(pois(spark, sf_dir), 139.5, 35.5, 20, ["category"], ["poi"]).select("category", "poi", _r(F.col("m"), 3, "m"), "rank")


@query(f"""
WITH s AS ({STATIONS}), p AS ({POIS} WHERE c_mktsegment = 'BUILDING'), d AS (SELECT station, poi, {hav('s.lon', 's.lat', 'p.lon', 'p.lat')} AS m FROM s, p)
SELECT station, arg_min(poi, (m, poi)) AS poi, round(min(m), 3) AS m FROM d GROUP BY station""")
def nearest_of_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each station's nearest point of one category, however far."""
    p = pois(spark, sf_dir).filter("category = 'BUILDING'").select("poi", F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    return spatial_join.nearest_anywhere(stations(spark, sf_dir), p, ["station"], F.col("poi"), tie=F.col("poi")).select("station", F.col("best").alias("poi"), _r(F.col("m"), 3, "m"))


@query(f"""
WITH s AS ({STATIONS}), p AS ({POIS}), d AS (SELECT station, poi, {hav('s.lon', 's.lat', 'p.lon', 'p.lat')} AS m FROM s, p), r AS (SELECT unnest([1200.0, 2400, 4800, 9600, 19200, 38400, 76800, 153600, 200000]::DOUBLE[]) AS radius),
c AS (SELECT station, radius, count(*) FILTER (m <= radius) AS n FROM d, r GROUP BY 1, 2)
SELECT station, min(radius) FILTER (n > 10 OR radius >= 200000) AS radius, arg_min(n, radius) FILTER (n > 10 OR radius >= 200000)::BIGINT AS found FROM c GROUP BY station""")
def progressive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first radius of a doubling ladder that finds more than 10 candidates."""
    return search.progressive(stations(spark, sf_dir), pois(spark, sf_dir), 600.0)


NATION_BOX = f"{LON.format('(n_nationkey * 37 + 5)')} - 0.15003 AS w, {LAT.format('(n_nationkey * 37 + 5)')} - 0.15003 AS s, {LON.format('(n_nationkey * 37 + 5)')} + 0.15003 AS e, {LAT.format('(n_nationkey * 37 + 5)')} + 0.15003 AS n"
AREAS = f"SELECT n_nationkey AS area, n_name AS area_name, n_regionkey AS level, {NATION_BOX} FROM nation"
DIAMOND = "abs(lon - (w + e) / 2) + abs(lat - (s + n) / 2) < 0.15003"


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as boundaries: diamonds of 0.15 degrees, with a box; the region stands for the admin level."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area"), F.col("n_name").alias("area_name"), F.col("n_regionkey").alias("level"), (F.col("n_nationkey") * 37 + 5).cast("long").alias("k"))
    n = n.withColumn("x", lon_of("k")).withColumn("y", lat_of("k"))
    p = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    n = n.withColumn("multi", F.array(F.array(F.array(p(-0.15003, 0), p(0, -0.15003), p(0.15003, 0), p(0, 0.15003), p(-0.15003, 0)))))
    return n.withColumn("box", geo.bbox(F.col("x") - 0.15003, F.col("y") - 0.15003, F.col("x") + 0.15003, F.col("y") + 0.15003)).drop("k", "x", "y")


@query(f"WITH p AS ({POIS}), a AS ({AREAS}) SELECT poi, area, level FROM p, a WHERE {DIAMOND}")
def areas_of_pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All boundaries that hold each point (grid join, then point in polygon)."""
    return spatial_join.points_in_polygons(pois(spark, sf_dir), areas(spark, sf_dir)).select("poi", "area", "level")


@query(f"""
WITH p AS ({POIS}), a AS ({AREAS}), h AS (SELECT poi, area, area_name, level FROM p, a WHERE {DIAMOND})
SELECT poi, arg_min(area, (level, area)) AS area, arg_min(area_name, (level, area)) AS area_name FROM h GROUP BY poi""")
def first_area_of_pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial_join.first_polygon(pois(spark, sf_dir), areas(spark, sf_dir), ["poi"], [F.col("level"), F.col("area")]).select("poi", "area", "area_name")


@query(f"WITH p AS ({POIS}), a AS ({AREAS}) SELECT poi, arg_min(area, (round((e - w) * (n - s), 12), area)) AS area FROM p, a WHERE lon BETWEEN w AND e AND lat BETWEEN s AND n GROUP BY poi")
def covering_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest region box over each point; equal areas by key."""
    return spatial_join.covering_box(pois(spark, sf_dir), areas(spark, sf_dir).select("area", "box"), ["poi"], "area")


@query(f"""
WITH s0 AS ({STATIONS}), s1 AS (SELECT *, min(station) OVER (PARTITION BY lon, lat) AS first FROM s0), s AS (SELECT * FROM s1 WHERE station = first)
SELECT a.station AS a, b.station AS b, round({hav('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 3) AS m FROM s a, s b WHERE a.station < b.station AND {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 30000
UNION ALL SELECT first, station, 0.0 FROM s1 WHERE station <> first""")
def station_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations within 30 km of each other, as links: the smallest station of each place stands for it and is paired with those
    of other places; the others of its place are linked to it alone (0 m)."""
    s = save(equals.with_first(stations(spark, sf_dir).select("station", "lon", "lat"), "station", ["lon", "lat"]))
    one = s.filter("station = first").repartition(spark.sparkContext.defaultParallelism)  # each row meets many
    a = one.select(F.col("station").alias("a"), "lon", "lat")
    b = one.select(F.col("station").alias("b"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    pairs = spatial_join.within_distance(a, b, 30000.0).filter("a < b").select("a", "b", _r(F.col("m"), 3, "m"))
    return pairs.unionByName(s.filter("station <> first").select(F.col("first").alias("a"), F.col("station").alias("b"), F.lit(0.0).alias("m")))


@query(f"""
WITH RECURSIVE s AS ({STATIONS}), x AS (SELECT station, lon - 0.02 AS w, lon + 0.02 AS e, lat - 0.02 AS s, lat + 0.02 AS n FROM s),
l AS (SELECT a.station AS a, b.station AS b FROM x a JOIN x b ON a.w <= b.e AND a.e >= b.w AND a.s <= b.n AND a.n >= b.s),
r(node, seen) AS (SELECT a, b FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a)
SELECT node AS station, min(seen) AS component FROM r GROUP BY node""")
def zone_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations whose zones' boxes overlap, directly or through others."""
    s = stations(spark, sf_dir).withColumn("box", geo.bbox(F.col("lon") - 0.02, F.col("lat") - 0.02, F.col("lon") + 0.02, F.col("lat") + 0.02))
    edges = spatial_join.overlap_links(s.select("station", "box"), "station", 0.05)
    return connected_components(s.select(F.col("station").alias("node")), edges).select(F.col("node").alias("station"), "component")


# --- elimination

RADAR = ((1, 139.5, 35.5, 30000.0, "positive"), (2, 139.2, 35.8, 25000.0, "negative"), (4, 139.9, 35.1, 500000.0, "unanswered"))
HOTTER = (3, 139.4, 35.4, 139.6, 35.7)
GRID = 60
CELLS = f"SELECT i AS cell, 139.0::DOUBLE + (i % {GRID} + 0.5) * (1.0::DOUBLE / {GRID}) AS lon, 35.0::DOUBLE + (floor(i / {GRID}) + 0.5) * (1.0::DOUBLE / {GRID}) AS lat FROM range({GRID * GRID}) t(i)"
SIDE = "((lon - 139.5) * 111320 * cos(radians(35.55)) * ((139.6 - 139.5) * 111320 * cos(radians(35.55))) + (lat - 35.55) * 111320 * ((35.7 - 35.55) * 111320))"


@query(f"""
WITH s AS ({STATIONS})
SELECT station, round({hav('lon', 'lat', '139.5', '35.5')}, 3) AS m, {hav('lon', 'lat', '139.5', '35.5')} <= 30000 AS radar, {SIDE} >= 0 AS hotter,
  {hav('lon', 'lat', '139.2', '35.8')} > 25000 AS far, {hav('lon', 'lat', '139.5', '35.5')} <= 30000 AND {SIDE} >= 0 AND {hav('lon', 'lat', '139.2', '35.8')} > 25000 AS eligible
FROM s""")
def eligible_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations left after two radar answers and a thermometer: questions x stations as constraints, then all at once."""
    questions = spark.createDataFrame([(q, x, y, r, a) for q, x, y, r, a in RADAR], "ord int, clon double, clat double, r double, answer string").filter("answer <> 'unanswered'")
    s = stations(spark, sf_dir)
    tests = s.crossJoin(F.broadcast(questions)).select("station", "ord", (elimination.radar_holds("lon", "lat", "clon", "clat", "r") == (F.col("answer") == "positive")).alias("holds"))
    o, x1, y1, x2, y2 = HOTTER
    side = s.select("station", F.lit(o).alias("ord"), (geo.toward_second("lon", "lat", F.lit(x1), F.lit(y1), F.lit(x2), F.lit(y2)) >= 0).alias("holds"))
    by = tests.union(side).groupBy("station").agg(*(F.bool_or((F.col("ord") == k) & F.col("holds")).alias(n) for k, n in ((1, "radar"), (3, "hotter"), (2, "far"))), F.bool_and("holds").alias("eligible"))
    return s.withColumn("m", F.round(geo.haversine_m("lon", "lat", 139.5, 35.5), 3)).join(by, "station").select("station", "m", "radar", "hotter", "far", "eligible")


def _tests(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    """(cell, ord, holds) of the questions below, over the cells: two radars, a thermometer, and the nearest station."""
    r = []
    for q, x, y, m, a in RADAR:
        holds = (geo.haversine_m("lon", "lat", x, y) <= m) == (a == "positive")
        r.append(cells.select("cell", F.lit(q).alias("ord"), F.when(F.lit(a != "unanswered"), holds).alias("holds")))
    o, x1, y1, x2, y2 = HOTTER
    r.append(cells.select("cell", F.lit(o).alias("ord"), (geo.toward_second("lon", "lat", F.lit(x1), F.lit(y1), F.lit(x2), F.lit(y2)) >= 0).alias("holds")))
    near = spatial_join.within_distance(cells.select("cell", "lon", "lat"), stations(spark, sf_dir).select(F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat")), 9000.0)
    hit = near.groupBy("cell").agg(F.lit(True).alias("near"))
    r.append(cells.join(hit, "cell", "left").select("cell", F.lit(5).alias("ord"), F.coalesce("near", F.lit(False)).alias("holds")))
    out = r[0]
    for x in r[1:]:
        out = out.union(x)
    return out


@query(f"""
WITH c AS (SELECT *, (1.0::DOUBLE / {GRID}) * (1.0::DOUBLE / {GRID}) * 111320.0 * 111320.0 * cos(radians(lat)) AS m2 FROM ({CELLS})), s AS (SELECT lon AS slon, lat AS slat FROM ({STATIONS})),
h AS (SELECT c.*, {hav('lon', 'lat', '139.5', '35.5')} <= 30000 AS q1, NOT {hav('lon', 'lat', '139.2', '35.8')} <= 25000 AS q2, {SIDE} >= 0 AS q3, (SELECT min({hav('c.lon', 'c.lat', 'slon', 'slat')}) FROM s) <= 9000 AS q5 FROM c),
a AS (SELECT 1 AS ord, sum(m2) AS before, sum(m2) FILTER (q1) AS after, sum(m2) AS zone FROM h UNION ALL SELECT 2, sum(m2) FILTER (q1), sum(m2) FILTER (q1 AND q2), sum(m2) FROM h
  UNION ALL SELECT 3, sum(m2) FILTER (q1 AND q2), sum(m2) FILTER (q1 AND q2 AND q3), sum(m2) FROM h UNION ALL SELECT 4, sum(m2) FILTER (q1 AND q2 AND q3), sum(m2) FILTER (q1 AND q2 AND q3), sum(m2) FROM h
  UNION ALL SELECT 5, sum(m2) FILTER (q1 AND q2 AND q3), sum(m2) FILTER (q1 AND q2 AND q3 AND q5), sum(m2) FROM h)
SELECT ord, round(before / 1e6, 3) AS before_km2, round(after / 1e6, 3) AS after_km2, greatest(0, least(100, floor((before - after) * 100 / zone + 0.5)))::INT AS percent FROM a""")
def question_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question takes away, in order, over a grid of cells."""
    cells = elimination.cell_grid(spark, 139.0, 35.0, 140.0, 36.0, GRID)
    out = elimination.contributions(_tests(spark, sf_dir, cells), cells, F.lit(True))
    return out.select("ord", _r(F.col("before_m2") / 1e6, 3, "before_km2"), _r(F.col("after_m2") / 1e6, 3, "after_km2"), "percent")


@query(f"""
WITH c AS (SELECT *, (1.0::DOUBLE / {GRID}) * (1.0::DOUBLE / {GRID}) * 111320.0 * 111320.0 * cos(radians(lat)) AS m2, {hav('lon', 'lat', '139.5', '35.5')} <= 30000 AND {SIDE} >= 0 AS ok FROM ({CELLS})), s AS (SELECT station, lon AS slon, lat AS slat FROM ({STATIONS}))
SELECT station, round(sum(m2) / 1e6, 3) AS zone_km2, round(coalesce(sum(m2) FILTER (ok), 0) / 1e6, 3) AS left_km2, round(coalesce(sum(m2) FILTER (ok), 0) / sum(m2), 4) AS fraction,
  greatest(0, least(100, floor((1 - coalesce(sum(m2) FILTER (ok), 0) / sum(m2)) * 100 + 0.5)))::INT AS percent
FROM s, c WHERE {hav('slon', 'slat', 'lon', 'lat')} <= 5000 GROUP BY station""")
def station_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each station's zone of 5 km after a radar and a thermometer."""
    cells = elimination.cell_grid(spark, 139.0, 35.0, 140.0, 36.0, GRID)
    ok = (geo.haversine_m("lon", "lat", 139.5, 35.5) <= 30000) & (geo.toward_second("lon", "lat", *(F.lit(v) for v in HOTTER[1:])) >= 0)
    out = elimination.station_areas(stations(spark, sf_dir), cells.withColumn("eligible", ok), 5000.0)
    return out.select("station", _r(F.col("zone_m2") / 1e6, 3, "zone_km2"), _r(F.col("left_m2") / 1e6, 3, "left_km2"), _r(F.col("fraction"), 4, "fraction"), elimination.zone_percent(F.col("left_m2"), F.col("zone_m2")).alias("percent"))


@query(f"""
WITH c AS ({CELLS}), p AS (SELECT poi, lon AS plon, lat AS plat FROM ({POIS}) WHERE category = 'MACHINERY'),
d AS (SELECT cell, arg_min(poi, (round(pow(lon - plon, 2) + pow(lat - plat, 2), 14), poi)) AS poi FROM c, p GROUP BY cell)
SELECT poi, count(*) AS cells FROM d GROUP BY poi""")
def matching_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by their nearest candidate, in plain degrees: the membership form of a Voronoi diagram."""
    cells = elimination.cell_grid(spark, 139.0, 35.0, 140.0, 36.0, GRID)
    candidates = pois(spark, sf_dir).filter("category = 'MACHINERY'").select("poi", F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    return spatial_join.nearest_in_plane(cells, candidates, ["cell"], "poi").groupBy("poi").agg(F.count(F.lit(1)).alias("cells"))


@query(f"""
WITH c AS ({CELLS}), p AS (SELECT lon AS plon, lat AS plat FROM ({POIS}) WHERE category = 'FURNITURE'), d AS (SELECT min({hav('139.45', '35.55', 'plon', 'plat')}) AS r FROM p),
m AS (SELECT cell, min({hav('lon', 'lat', 'plon', 'plat')}) AS m FROM c, p GROUP BY cell)
SELECT count(*) FILTER (m <= r) AS closer, count(*) FILTER (m > r) AS further, round(any_value(r), 3) AS seeker_m FROM m, d""")
def measuring_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that lie as near to a category as the seeker does, and the others."""
    cells = elimination.cell_grid(spark, 139.0, 35.0, 140.0, 36.0, GRID)
    p = pois(spark, sf_dir).filter("category = 'FURNITURE'").select("poi", F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    return search.measure_cells(cells, p, 139.45, 35.55)
