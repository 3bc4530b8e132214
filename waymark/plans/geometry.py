"""Queries: built geometry, codecs, ordered algorithms, captured sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo, kernels, rings
from waymark.operators import measuring, overlay, sequences
from waymark.plans.registry import LAT, LON, hav, pos, query
from waymark.plans.spatial import AREAS, DIAMOND, POIS, RING_SQL, STATIONS, areas
from waymark.plans.transit import stop_times
from waymark.session import placed, pois, stations, table
from waymark.sources import readers
from waymark.streaming import events as streams


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines through their suppliers: line_id, line."""
    t = placed(stop_times(spark, sf_dir).withColumnRenamed("l_suppkey", "k"), "k", "x", "y")
    return t.groupBy(F.col("l_orderkey").alias("line_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("line"))


@query(f"""{RING_SQL} SELECT station, 221 AS bytes, round(sum((x * y2 - x2 * y) / 2), 8) AS area, true AS same FROM p GROUP BY station""")
def wkb_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones as well-known binary and back."""
    s = stations(spark, sf_dir).withColumn("multi", F.array(F.array(geo.circle_ring("lon", "lat", 600.0, 12))))
    s = s.withColumn("raw", kernels.multipolygon_wkb("multi")).withColumn("back", kernels.wkb_multipolygon("raw")).withColumn("ring", F.col("back")[0][0])
    return s.select("station", F.length("raw").alias("bytes"), F.round(rings.planar_area(F.col("ring")), 8).alias("area"), (F.col("back") == F.col("multi")).alias("same"))


@query(f"""
WITH p AS ({POIS}), q AS (SELECT poi // 100 AS question, round(lon, 6) AS lon, round(lat, 6) AS lat FROM p)
SELECT question, count(DISTINCT (lon, lat)) AS cells, 1.0::DOUBLE AS area FROM q GROUP BY question""")
def voronoi_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voronoi cells of each question's candidates: as many as distinct places, and together the whole box."""
    p = pois(spark, sf_dir).withColumn("question", F.floor(F.col("poi") / 100))
    cells = sequences.voronoi_cells(p, "poi", (139.0, 35.0, 140.0, 36.0))
    area = F.abs(rings.planar_area(F.col("cell")))
    return cells.withColumn("a", area).groupBy("question").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("a"), 6).alias("area"))


@query(f"""
WITH s AS ({STATIONS}), c AS (SELECT station, greatest(0, least(lon + 0.1, 139.8) - greatest(lon - 0.1, 139.2)) * greatest(0, least(lat + 0.1, 35.8) - greatest(lat - 0.1, 35.2)) AS area FROM s)
SELECT station, round(area, 8) AS area FROM c""")
def clipped_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares around stations cut to the play area."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = lambda w, s, e, n: F.array(p(w, s), p(e, s), p(e, n), p(w, n), p(w, s))
    x, y = F.col("lon"), F.col("lat")
    s = stations(spark, sf_dir).withColumn("ring", ring(x - 0.1, y - 0.1, x + 0.1, y + 0.1)).withColumn("area_ring", ring(*(F.lit(v) for v in (139.2, 35.2, 139.8, 35.8))))
    s = s.withColumn("cut", kernels.clip_to_convex("ring", "area_ring"))
    return s.select("station", F.round(F.abs(rings.planar_area(F.col("cut"))), 8).alias("area"))


D = "list_transform(range(a + 1, b), lambda k: {far})"
#: The distance of point k from the segment a-b in local metres, and the farthest of the points between.
FAR = "sqrt(pow(xs[k] - xs[a] - {t} * (xs[b] - xs[a]), 2) + pow(ys[k] - ys[a] - {t} * (ys[b] - ys[a]), 2))"
SHARE = "CASE WHEN pow(xs[b] - xs[a], 2) + pow(ys[b] - ys[a], 2) = 0 THEN 0 ELSE greatest(0, least(1, ((xs[k] - xs[a]) * (xs[b] - xs[a]) + (ys[k] - ys[a]) * (ys[b] - ys[a])) / (pow(xs[b] - xs[a], 2) + pow(ys[b] - ys[a], 2)))) END"
FARS = D.format(far=FAR.format(t=f"({SHARE})"))


@query(f"""
WITH RECURSIVE t AS (SELECT l_orderkey AS line_id, l_linenumber AS seq, {pos('l_suppkey', 'x', 'y')} FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2)),
l AS (SELECT line_id, list(x ORDER BY seq) AS lon, list(y ORDER BY seq) AS lat, count(*) AS n, cos(radians(avg(y))) AS k FROM t GROUP BY line_id),
m AS (SELECT line_id, n, lon, lat, list_transform(lon, lambda v: v * 111320 * k) AS xs, list_transform(lat, lambda v: v * 111320) AS ys FROM l),
r(line_id, xs, ys, a, b) AS (
  SELECT line_id, xs, ys, 1::BIGINT, n::BIGINT FROM m
  UNION ALL SELECT line_id, xs, ys, unnest([a, c]), unnest([c, b]) FROM (SELECT line_id, xs, ys, a, b, a + list_position(list_transform(fars, lambda v: v >= list_max(fars) * (1 - 1e-9)), true) AS c, list_max(fars) AS f FROM (SELECT *, {FARS} AS fars FROM r WHERE b - a > 1)) WHERE f > 20000 * (1 + 1e-9)),
e AS (SELECT DISTINCT line_id, unnest([a, b]) AS i FROM r),
g AS (SELECT line_id, list(i ORDER BY i) AS keep FROM e GROUP BY line_id),
h AS (SELECT m.*, keep, list_transform(keep, lambda i: lon[i]) AS lon2, list_transform(keep, lambda i: lat[i]) AS lat2 FROM m JOIN g USING (line_id))
SELECT line_id, n::INT AS points, len(keep)::INT AS kept, round(coalesce(list_sum(list_transform(range(1, n), lambda i: {hav('lon[i]', 'lat[i]', 'lon[i + 1]', 'lat[i + 1]')})), 0), 1) AS m,
  round(coalesce(list_sum(list_transform(range(1, len(keep)), lambda i: {hav('lon2[i]', 'lat2[i]', 'lon2[i + 1]', 'lat2[i + 1]')})), 0), 1) AS kept_m FROM h""")
def simplified_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines simplified to 20 km: points before and after, and how much length is left."""
    li = order_lines(spark, sf_dir).withColumn("short", kernels.simplify_m(20000.0)("line"))
    return li.select("line_id", F.size("line").alias("points"), F.size("short").alias("kept"), F.round(rings.length_m(F.col("line")), 1).alias("m"), F.round(rings.length_m(F.col("short")), 1).alias("kept_m"))


def _apart(p: str, q: str) -> str:
    return hav(f"{p}.x", f"{p}.y", f"{q}.x", f"{q}.y", "6371000.0")


#: Gaps of a list of stops, the limit above which one is implausible, and the first one that is.
GAPS = f"""SELECT *, nullif(list_position(list_transform(gaps, lambda g: g > lim), true), 0) AS bad FROM (
  SELECT *, greatest(20000, 4 * coalesce(list_aggregate(list_concat(gaps[:w - 1], gaps[w + 1:]), 'median'), 0)) AS lim FROM (
    SELECT *, list_position(gaps, list_max(gaps)) AS w FROM (SELECT *, list_transform(range(1, len(pts)), lambda i: {_apart('pts[i]', 'pts[i + 1]')}) AS gaps FROM {{0}})))"""
COSTS = f"""list_transform(range(0, len(o) + 1), lambda i: CASE WHEN i > 0 THEN {_apart('o[i]', 'm')} ELSE 0 END + CASE WHEN i < len(o) THEN {_apart('o[i + 1]', 'm')} ELSE 0 END - CASE WHEN i > 0 AND i < len(o) THEN {_apart('o[i]', 'o[i + 1]')} ELSE 0 END)"""


@query(f"""
WITH RECURSIVE t AS (SELECT l_orderkey AS variant, l_linenumber AS seq, min(l_suppkey) AS id FROM lineitem GROUP BY 1, 2),
v AS (SELECT variant, list({{'id': id, 'x': {LON.format('id')}, 'y': {LAT.format('id')}}} ORDER BY seq) AS pts FROM t GROUP BY variant),
r(variant, pts, orig, step) AS (
  SELECT variant, pts, pts, 0 FROM v
  UNION ALL SELECT variant, list_concat(o[:c], [m], o[c + 1:]), orig, step + 1 FROM (SELECT *, list_position(costs, list_min(costs)) - 1 AS c FROM (SELECT *, {COSTS} AS costs FROM (
    SELECT *, pts[k] AS m, list_concat(pts[:k - 1], pts[k + 1:]) AS o FROM (SELECT *, CASE WHEN bad = 1 THEN 1 ELSE bad + 1 END AS k FROM ({GAPS.format('(SELECT * FROM r WHERE step < 3 AND len(pts) > 2)')}) WHERE bad IS NOT NULL))))),
f AS (SELECT variant, arg_max(pts, step) AS pts, any_value(orig) AS orig FROM r GROUP BY variant),
g AS (SELECT variant, CASE WHEN bad IS NULL THEN pts ELSE orig END AS pts FROM ({GAPS.format('f')})),
x AS (SELECT variant, pts, unnest(range(1, len(pts) + 1)) AS i FROM g)
SELECT variant, (i - 1)::INT AS seq, pts[i].id AS id FROM x""")
def repaired_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = placed(stop_times(spark, sf_dir).select(F.col("l_orderkey").alias("variant"), F.col("l_linenumber").alias("seq"), F.col("l_suppkey").alias("id")), "id")
    return sequences.repair_stops(t).select("variant", "seq", "id")


@query("""
WITH RECURSIVE t AS (SELECT o_custkey AS relation, l_orderkey * 10 + l_linenumber AS ord, min(l_suppkey) % 8 AS a, l_linenumber::BIGINT AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, l_linenumber),
w AS (SELECT relation, list({'a': a, 'b': b} ORDER BY ord) AS ways FROM t GROUP BY relation),
s(relation, part, points, head, tail, rest) AS (
  SELECT relation, 0, 2, ways[1].a, ways[1].b, ways[2:] FROM w
  UNION ALL SELECT relation, CASE WHEN k IS NULL THEN part + 1 ELSE part END, CASE WHEN k IS NULL THEN 2 ELSE points + 1 END,
    CASE WHEN k IS NULL THEN rest[1].a WHEN v.a = tail OR v.b = tail THEN head WHEN v.b = head THEN v.a ELSE v.b END,
    CASE WHEN k IS NULL THEN rest[1].b WHEN v.a = tail THEN v.b WHEN v.b = tail THEN v.a ELSE tail END,
    CASE WHEN k IS NULL THEN rest[2:] ELSE list_concat(rest[:k - 1], rest[k + 1:]) END
  FROM (SELECT *, rest[k] AS v FROM (SELECT *, nullif(list_position(list_transform(rest, lambda x: x.a = tail OR x.b = tail OR x.a = head OR x.b = head), true), 0) AS k FROM s WHERE len(rest) > 0)))
SELECT relation, part::INT AS part, max(points)::INT AS points FROM s GROUP BY relation, part""")
def stitched_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways (pairs of suppliers) chained by shared ends within each customer's relation."""
    li = stop_times(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("relation")), "l_orderkey")
    li = placed(li.withColumn("k", F.col("l_suppkey") % 8), "k", "ax", "ay").withColumn("k", F.col("l_linenumber").cast("long"))
    li = placed(li, "k", "bx", "by")
    line = F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))
    ways = li.select("relation", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), line.alias("line"))
    return sequences.stitch_ways(ways).select("relation", "part", F.size("line").alias("points"))


@query(f"""
WITH c AS (SELECT c_custkey AS ord, 'n' || c_custkey % 1200 AS id, 's' || c_custkey // 8 AS normalised, CASE WHEN c_custkey % 4 = 0 THEN 'Q' || c_custkey % 300 END AS wikidata, {pos('(c_custkey // 4)')},
  CASE WHEN c_custkey % 3 = 0 THEN 4 ELSE 0 END + 3 + CASE WHEN c_mktsegment <> '' THEN 2 ELSE 0 END + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS score FROM customer),
a AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1),
b AS (SELECT * REPLACE (min(ord) OVER (PARTITION BY wikidata) AS ord) FROM a WHERE wikidata IS NOT NULL QUALIFY row_number() OVER (PARTITION BY wikidata ORDER BY score DESC, a.ord) = 1
  UNION ALL SELECT * FROM a WHERE wikidata IS NULL)
SELECT id, normalised, wikidata FROM b QUALIFY row_number() OVER (PARTITION BY normalised, lon, lat ORDER BY ord) = 1""")  # stations of one name stand in one place or kilometres apart here
def deduped_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station records of three rounds of entity resolution."""
    k = F.col("c_custkey")
    s = placed(table(spark, sf_dir, "customer").withColumn("k", F.floor(k / 4)), "k")
    s = s.select(
        F.concat(F.lit("n"), (k % 1200).cast("string")).alias("id"), F.col("c_name").alias("name"), F.when(k % 3 == 0, F.col("c_name")).alias("name_en"), F.concat(F.lit("s"), F.floor(k / 8).cast("string")).alias("normalised"),
        F.when(k % 4 == 0, F.concat(F.lit("Q"), (k % 300).cast("string"))).alias("wikidata"), F.col("c_mktsegment").alias("operator"), F.create_map(F.lit("railway"), F.lit("station")).alias("tags"), "lon", "lat", k.alias("ord"),
    )
    return sequences.dedupe_stations(s).select("id", "normalised", "wikidata")


@query(f"""
WITH c AS (SELECT c_custkey AS k, c_name, {LON.format('c_custkey')} AS lon FROM customer)
SELECT k AS osm_id, CASE WHEN k % 4 = 1 THEN 'way' ELSE 'node' END AS type, CASE WHEN k % 2 = 0 THEN c_name ELSE 'plain' || k END AS name, length(CASE WHEN k % 2 = 0 THEN c_name ELSE 'plain' || k END)::INT AS name_length, round(lon, 6) AS lon
FROM c WHERE k % 5 <> 0""")
def parsed_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured responses, one for each customer segment and nation, parsed to points."""
    k = F.col("c_custkey")
    p = placed(table(spark, sf_dir, "customer"), "c_custkey")
    way = k % 4 == 1
    none = F.lit(None).cast("double")
    name = F.when(k % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" plain"), k.cast("string"), F.lit(" ")))
    tags = F.map_filter(F.create_map(F.lit("name"), name, F.lit("name:en"), F.when((k % 2 == 0) & (k % 5 != 0), F.col("c_name"))), lambda _, v: v.isNotNull())
    e = F.struct(
        F.when(way, "way").otherwise("node").alias("type"), k.alias("id"), F.when(way, none).otherwise(F.col("lat")).alias("lat"), F.when(way, none).otherwise(F.col("lon")).alias("lon"),
        F.when(way, F.struct("lat", "lon")).alias("center"), tags.alias("tags"),
    )
    captured = p.groupBy("c_mktsegment", "c_nationkey").agg(F.to_json(F.struct(F.collect_list(e).alias("elements"))).alias("json")).select("json")
    out = readers.parse_elements(captured, category="station-name-length")
    return out.select("osm_id", "type", "name", F.col("name_length").cast("int").alias("name_length"), F.round("lon", 6).alias("lon"))


@query("""
SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts from a stream with a watermark."""
    out = streams.run_to_end(streams.windowed_counts(streams.read_events(spark, f"{sf_dir}/events.parquet")), "update", ["start", "event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, count(*) AS n, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def streamed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest request, from keyed streaming state."""
    return streams.run_to_end(streams.latest_requests(streams.read_events(spark, f"{sf_dir}/events.parquet")), "update", ["user_id"])


RASTER = f"""WITH a AS ({AREAS}), g AS (SELECT *, unnest(range(floor(s / 0.02)::BIGINT, floor(n / 0.02)::BIGINT + 1)) AS cy FROM a), c AS (SELECT *, unnest(range(floor(w / 0.02)::BIGINT, floor(e / 0.02)::BIGINT + 1)) AS cx FROM g),
r AS (SELECT area, level, cx, cy FROM (SELECT *, (cx + 0.5) * 0.02::DOUBLE AS lon, (cy + 0.5) * 0.02::DOUBLE AS lat FROM c) WHERE {DIAMOND})"""


@query(f"""{RASTER}, d AS (SELECT DISTINCT cx, cy, floor(cx / 64.0) AS tx, floor(cy / 64.0) AS ty FROM r), k AS (SELECT *, cx - row_number() OVER (PARTITION BY tx, ty, cy ORDER BY cx) AS run FROM d),
m AS (SELECT tx, ty, cy, run, count(*) AS cells FROM k GROUP BY 1, 2, 3, 4) SELECT count(*) AS pieces, sum(cells)::BIGINT AS cells, max(cells) AS widest FROM m""")
def dissolved_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All boundaries dissolved: the rectangles of covered cells, by tile."""
    out = overlay.dissolve(overlay.rasterise(areas(spark, sf_dir), ["area"], 0.02), 0.02)
    return out.agg(F.count(F.lit(1)).alias("pieces"), F.sum("cells").alias("cells"), F.max("cells").alias("widest"))


@query(f"""{RASTER}, s AS (SELECT *, 0.02::DOUBLE * 0.02 * 111320 * 111320 * cos(radians((cy + 0.5) * 0.02::DOUBLE)) AS m2 FROM (SELECT level, cx, cy, bool_or(area % 2 = 0) AS a, bool_or(area % 2 = 1) AS b FROM r GROUP BY 1, 2, 3))
SELECT level, round(sum(m2) / 1e6, 3) AS union_km2, round(coalesce(sum(m2) FILTER (a AND b), 0) / 1e6, 3) AS both_km2, round(coalesce(sum(m2) FILTER (a AND NOT b), 0) / 1e6, 3) AS only_a_km2 FROM s GROUP BY level""")
def overlay_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference of each level's boundaries with even and with odd keys."""
    r = overlay.rasterise(areas(spark, sf_dir), ["area", "level"], 0.02)
    out = overlay.overlay_areas(r.filter("area % 2 = 0"), r.filter("area % 2 = 1"), "level", 0.02)
    return out.select("level", *(F.round(F.col(f"{k}_m2") / 1e6, 3).alias(f"{k}_km2") for k in ("union", "both", "only_a")))


@query(f"""
WITH s AS ({STATIONS}), a AS (SELECT area, level, w, e, s AS lo, n AS hi, (w + e) / 2 AS cx, (s + n) / 2 AS cy FROM ({AREAS}) WHERE level = 1),
g AS (SELECT area, cx - 0.15003 AS ax, cy AS ay, cx AS bx, cy - 0.15003 AS b_y FROM a UNION ALL SELECT area, cx, cy - 0.15003, cx + 0.15003, cy FROM a UNION ALL SELECT area, cx + 0.15003, cy, cx, cy + 0.15003 FROM a UNION ALL SELECT area, cx, cy + 0.15003, cx - 0.15003, cy FROM a),
t AS (SELECT station, lon, lat, ax, ay, bx, b_y, greatest(0, least(1, ((lon - ax) * cos(radians(lat)) * (bx - ax) * cos(radians(lat)) + (lat - ay) * (b_y - ay)) / (pow((bx - ax) * cos(radians(lat)), 2) + pow(b_y - ay, 2)))) AS t FROM s, g
  WHERE least(ax, bx) <= lon + 50000 / (111320 * cos(radians(lat))) AND greatest(ax, bx) >= lon - 50000 / (111320 * cos(radians(lat))) AND least(ay, b_y) <= lat + 50000 / 111320.0 AND greatest(ay, b_y) >= lat - 50000 / 111320.0),
d AS (SELECT station, min({hav('lon', 'lat', '(ax + t * (bx - ax))', '(ay + t * (b_y - ay))', '6371000.0')}) AS m FROM t GROUP BY station),
i AS (SELECT DISTINCT station FROM s, a WHERE abs(lon - cx) + abs(lat - cy) < 0.15003)
SELECT s.station, round(CASE WHEN i.station IS NOT NULL THEN 0 ELSE m END, 2) AS m FROM s LEFT JOIN d USING (station) LEFT JOIN i ON i.station = s.station""")
def distance_to_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each station is from the nearest boundary of a level: 0 inside."""
    a = areas(spark, sf_dir).filter("level = 1").select("area", "box", "multi")
    return measuring.distance_to_areas(stations(spark, sf_dir).select("station", "lon", "lat"), a, "station").select("station", F.round("m", 2).alias("m"))


@query(f"""
WITH b AS (SELECT n_regionkey % 3 AS k, n_name AS source, n_nationkey AS f, {LON.format('n_nationkey')} AS x FROM nation) SELECT 'c' || k AS category, sum(f)::BIGINT AS features, round(min(x), 6) AS w, round(max(x) + 1, 6) AS e, string_agg(DISTINCT source, '; ' ORDER BY source) AS source FROM b GROUP BY k""")
def merged_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey").cast("long"))
    n = placed(n, "k").select(F.concat(F.lit("c"), F.col("n_regionkey") % 3).alias("category"), F.col("k").alias("features"), F.col("n_name").alias("source"), geo.bbox("lon", "lat", F.col("lon") + 1, F.col("lat") + 1).alias("box"))
    return measuring.merge_bundles(n).select("category", "features", F.round("box.w", 6).alias("w"), F.round("box.e", 6).alias("e"), "source")
