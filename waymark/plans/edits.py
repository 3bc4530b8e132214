"""Queries: edits of questions and stored states, names of stations and operators, lines linted, clipped and coded, eligible cells, merged presets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import geo, rings
from waymark.functions import text as tx
from waymark.operators import elimination, etl, families, measuring, overlay, state, transit, wire
from waymark.plans.registry import hav, pos, query
from waymark.plans.spatial import AREAS, STATIONS, areas
from waymark.plans.transit import TIMES, stop_times
from waymark.session import placed, stations, table


@query("""
WITH q AS (SELECT o_orderkey AS k, ['matching', 'radar', 'tentacles'][o_orderkey % 3 + 1] AS type, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 139.0::DOUBLE + o_custkey % 100 / 100.0::DOUBLE END AS lon,
  CASE o_orderkey % 5 WHEN 0 THEN NULL ELSE o_custkey + 1 END AS chosen, CASE o_orderkey % 4 WHEN 0 THEN '2.5' WHEN 1 THEN 'x' WHEN 2 THEN '-3' ELSE '40' END AS typed, ['km', 'mi', 'm'][o_orderkey % 3 + 1] AS unit, o_orderkey % 7 AS stations, CASE WHEN o_orderkey % 2 = 0 THEN 'negative' ELSE 'positive' END AS was FROM orders),
v AS (SELECT *, CASE WHEN try_cast(typed AS DOUBLE) > 0 THEN try_cast(typed AS DOUBLE) * CASE unit WHEN 'km' THEN 1000 WHEN 'mi' THEN 1609.344 ELSE 1 END ELSE 500 END AS metres FROM q)
SELECT k, CASE WHEN type = 'matching' AND lon IS NULL THEN 139.5 ELSE lon END AS lon, chosen::BIGINT AS selected, CASE WHEN chosen IS NULL THEN 'negative' ELSE 'positive' END AS answer, round(metres, 3) AS metres,
  'imported-t9-' || k AS imported_id, CASE WHEN was = 'negative' THEN 'negative' ELSE 'unanswered' END AS imported_answer,
  (k % 4) || ' question' || CASE WHEN k % 4 = 1 THEN '' ELSE 's' END || ', ' || stations || ' station' || CASE WHEN stations = 1 THEN '' ELSE 's' END || ', ' || CASE WHEN metres < 1000 THEN printf('%d', floor(metres + 0.5)::BIGINT) || ' meters' ELSE printf('%.1f', metres / 1000) || ' km' END || ' radius' AS summary
FROM v""")
def edited_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions after edits: a missing centre, a chosen place or an explicit no, a typed distance, an import, and the state's summary."""
    k = F.col("o_orderkey")
    pick = lambda *vs: F.element_at(F.array(*map(F.lit, vs)), (k % len(vs) + 1).cast("int"))
    q = table(spark, sf_dir, "orders").select(
        k.alias("k"), pick("matching", "radar", "tentacles").alias("type"), F.when(k % 4 != 0, F.lit(139.0) + F.col("o_custkey") % 100 / 100.0).alias("lon"), F.lit(35.0).alias("lat"), F.when(k % 5 != 0, (F.col("o_custkey") + 1).cast("long")).alias("chosen"),
        pick("2.5", "x", "-3", "40").alias("typed"), pick("km", "mi", "m").alias("unit"), (k % 7).alias("stations"), F.when(k % 2 == 0, "negative").otherwise("positive").alias("was"),
    )
    q = state.select_poi(state.fill_centres(q, F.lit(139.5), F.lit(35.5)), F.col("chosen")).withColumn("metres", state.set_distance(F.col("typed"), F.col("unit"), F.lit(500.0)))
    brought = state.imported(q.select("k", F.col("k").alias("ord"), F.col("was").alias("answer")), F.lit("t9")).select("k", F.col("id").alias("imported_id"), F.col("answer").alias("imported_answer"))
    out = q.join(brought, "k")
    return out.select("k", "lon", "selected", "answer", F.round("metres", 3).alias("metres"), "imported_id", "imported_answer", state.summary(F.col("k") % 4, F.col("stations"), F.col("metres")).alias("summary"))


@query("""
SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 THEN 1 END AS version, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END END::BIGINT AS play_area,
  CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 5 = 0 THEN 'imperial' ELSE 'metric' END END AS units, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 4 = 0 THEN '[]' ELSE '[{"id":"q1"}]' END END AS questions FROM customer""")
def migrated_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored states, slice by slice: those of another version or torn text give nulls, slices that don't parse their defaults."""
    k = F.col("c_custkey")
    area = F.when(k % 2 == 0, F.concat(F.lit('{"osmId":'), k, F.lit("}"))).otherwise(F.lit('"none"'))
    text = F.concat(
        F.lit('{"version":'), F.when(k % 3 == 0, "2").otherwise("1"), F.lit(',"playArea":'), area, F.lit(',"units":"'), F.when(k % 5 == 0, "imperial").when(k % 5 == 1, "metric").otherwise("cubits"),
        F.lit('","questions":'), F.when(k % 4 == 0, '"x"').otherwise('[{"id":"q1"}]'), F.lit("}"),
    )
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), F.when(k % 7 == 0, F.lit("{torn")).otherwise(text).alias("json"))
    return state.migrate_state(rows)


OPERATORS = {"Acme": ["ACME LINES", "acme rail"], "Best": ["Best & Co"]}


@query("""
WITH n AS (SELECT c_custkey AS k, '  ' || upper(c_name) || CASE c_custkey % 4 WHEN 0 THEN ' Station' WHEN 1 THEN '  Sta' WHEN 2 THEN '' ELSE ' STATION' END AS name, CASE c_custkey % 5 WHEN 0 THEN 'Acme; Best & Co' WHEN 1 THEN 'the acme rail company' WHEN 2 THEN 'Other;;ACME LINES' WHEN 3 THEN '' END AS operators, c_name FROM customer)
SELECT k, lower(c_name) AS station, CASE k % 5 WHEN 0 THEN 'Acme|Best' WHEN 1 THEN 'Acme' WHEN 2 THEN 'Other|Acme' ELSE '' END AS operators, CASE WHEN k % 3 = 0 THEN c_name || '|B' || k ELSE c_name END AS names FROM n""")
def station_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as they are compared: white space and affixes gone, operators under their canonical names, all names of a place."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("  "), F.upper("c_name"), F.element_at(F.array(*map(F.lit, (" Station", "  Sta", "", " STATION"))), (k % 4 + 1).cast("int")))
    operators = F.when(k % 5 == 0, "Acme; Best & Co").when(k % 5 == 1, "the acme rail company").when(k % 5 == 2, "Other;;ACME LINES").when(k % 5 == 3, "")
    tags = F.map_filter(F.create_map(F.lit("name"), F.col("c_name"), F.lit("name:en"), F.concat("c_name", F.lit(" ; ")), F.lit("alt_name"), F.when(k % 3 == 0, F.concat(F.lit("B"), k))), lambda _, v: v.isNotNull())
    c = table(spark, sf_dir, "customer").select(k.alias("k"), name.alias("name"), operators.alias("operators"), tags.alias("tags"))
    return c.select(
        "k", tx.station_key(F.col("name"), ["station", "sta"]).alias("station"), F.array_join(tx.split_operators(F.col("operators"), OPERATORS), "|").alias("operators"),
        F.array_join(tx.name_variants(F.col("tags"), ["name", "name:en", "alt_name"]), "|").alias("names"),
    )


def _share(axis: str, low: float, high: float) -> tuple[str, str]:
    a, d = f"a{axis}", f"(b{axis}_ - a{axis})"
    return f"CASE WHEN {d} = 0 THEN 0 ELSE least(({low} - {a}) / {d}, ({high} - {a}) / {d}) END", f"CASE WHEN {d} = 0 THEN 1 ELSE greatest(({low} - {a}) / {d}, ({high} - {a}) / {d}) END"


(X_IN, X_OUT), (Y_IN, Y_OUT) = _share("x", 139.3, 139.7), _share("y", 35.25, 35.75)


@query(f"""
WITH p AS (SELECT c_custkey AS k, {pos('c_custkey', 'ax', 'ay')}, {pos('(c_custkey + 29)', 'bx_', 'by_')} FROM customer),
t AS (SELECT *, greatest(0.0, {X_IN}, {Y_IN}) AS enter, least(1.0, {X_OUT}, {Y_OUT}) AS leave FROM p)
SELECT k, round(CASE WHEN enter <= leave THEN enter END, 6) AS enter, round(CASE WHEN enter <= leave THEN leave END, 6) AS leave, round((ax + bx_) / 2, 6) AS mid_x,
  round(greatest(abs(ax - 139.3), abs(bx_ - 139.7)) * 111320 * cos(radians((ay + by_) / 2)), 2) AS moved_x, floor(ax * 1000000 + 0.5)::BIGINT || ',' || floor(ay * 1000000 + 0.5)::BIGINT || ',2,' || (floor(bx_ * 1000000 + 0.5)::BIGINT - floor(ax * 1000000 + 0.5)::BIGINT) || ',' || (floor(by_ * 1000000 + 0.5)::BIGINT - floor(ay * 1000000 + 0.5)::BIGINT) AS code,
  round(bx_, 5) AS back_x, CASE WHEN k % 2 = 1 THEN printf('%d', k % 50) WHEN k % 50 < 10 THEN printf('%.2f', k % 50 + 0.5) ELSE printf('%.1f', k % 50 + 0.5) END AS shown
FROM t""")
def clipped_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments between customers cut to a box, their middles, the box's displacement, and their compact code and back."""
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") + 29).alias("k2"))
    p = placed(placed(p, "k", "ax", "ay"), "k2", "bx", "by")
    area = geo.bbox(139.3, 35.25, 139.7, 35.75)
    enter, leave = geo.clip_segment("ax", "ay", "bx", "by", area)
    p = p.withColumn("line", F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).withColumn("code", rings.compact_line(F.col("line")))
    p = p.withColumn("back", rings.expand_line(F.col("code"))).withColumn("own", geo.bbox("ax", "ay", "bx", "by"))
    level = geo.bbox(139.3, "ay", 139.7, "by")
    return p.select(
        "k", F.round(enter, 6).alias("enter"), F.round(leave, 6).alias("leave"), F.round(rings.box_centre_point(F.col("line"))["x"], 6).alias("mid_x"), F.round(geo.box_edge_delta_m(F.col("own"), level), 2).alias("moved_x"),
        F.array_join(F.transform("code", lambda v: v.cast("string")), ",").alias("code"), F.round(F.element_at("back", -1)["x"], 5).alias("back_x"), geo.from_metres((F.col("k") % 50 + F.when(F.col("k") % 2 == 0, 0.5).otherwise(0.0)) * 1000.0, F.lit("km")).alias("shown"),
    )


@query("""
WITH l AS (SELECT o_orderkey AS k, o_orderkey % 7 <> 0 AS id, o_orderkey % 3 <> 0 AS colour, o_orderkey % 4 AS n, o_orderkey % 300 AS routes FROM orders)
SELECT k, unnest(list_filter([CASE WHEN NOT id THEN 'route-id' END, CASE WHEN NOT colour THEN 'colour' END, CASE WHEN n < 2 THEN 'stations' END, CASE WHEN routes > CASE WHEN k % 2 = 0 THEN 50 ELSE 250 END THEN 'routes' END], lambda x: x IS NOT NULL)) AS rule FROM l""")
def linted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that lines break: id, colour, stations, and how many routes their operator has, fewer allowed for tracks."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("k"), F.when(k % 7 == 0, F.lit("odd")).otherwise(F.concat(F.lit("osm:relation:"), k + 1)).alias("route_id"), F.when(k % 3 == 0, "red").otherwise("#00ff00").alias("colour"),
        F.slice(F.array(*(F.lit(i) for i in range(4))), 1, (k % 4).cast("int")).alias("stations"), (k % 300).alias("operator_routes"),
    )
    return etl.lint(rows.filter("k % 2 = 0"), "k", etl.line_rules(infra=True)).unionByName(etl.lint(rows.filter("k % 2 = 1"), "k", etl.line_rules()))


@query(f"""
WITH a AS ({AREAS}), r AS (SELECT area, level, w, e, s, n FROM a)
SELECT area AS relation, 5 AS points, round(w, 5) AS w, round(n, 5) AS n, floor(round((w + e) / 2, 9) / 0.1)::BIGINT || ':' || floor(round((s + n) / 2, 9) / 0.1)::BIGINT AS bucket,
  CASE WHEN area % 4 = 0 THEN 'OSM relation ' || area ELSE 'N' || area END AS label, CASE WHEN area % 2 = 0 THEN 0 WHEN area % 3 = 0 THEN 1 END AS source FROM r""")
def border_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries as lines with boxes, their buckets, labels of the play areas they make, and the first source that has them."""
    a = areas(spark, sf_dir)
    lines = None
    for level in range(5):
        part = measuring.border_lines(a, level)
        lines = part if lines is None else lines.unionByName(part)
    outer = measuring.outer_lines(a).select("relation", F.size("line").alias("points"))
    id_ = F.col("area")
    named = a.select(id_.alias("id"), F.array(F.lit(" "), F.when(id_ % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("N"), id_))).alias("names"), "multi")
    areas_ = etl.play_area(named).select(F.col("id").alias("relation"), "label", F.concat_ws(":", F.floor(F.round("centre_lon", 9) / 0.1), F.floor(F.round("centre_lat", 9) / 0.1)).alias("bucket"))
    keys = a.select(id_.alias("relation_id"))
    bundled, cached = keys.filter("relation_id % 2 = 0").withColumn("v", F.lit("a")), keys.filter("relation_id % 3 = 0").withColumn("v", F.lit("b"))
    source = measuring.resolve_source(keys, bundled, cached).select(F.col("relation_id").alias("relation"), F.col("priority").alias("source"))
    out = lines.join(outer, "relation").join(areas_, "relation").join(source, "relation")
    return out.select("relation", "points", F.round("box.w", 5).alias("w"), F.round("box.n", 5).alias("n"), "bucket", "label", "source")


@query(f"""
WITH a AS ({AREAS}) SELECT floor(round((w + e) / 2, 9) / 0.1)::BIGINT AS bucket_x, floor(round((s + n) / 2, 9) / 0.1)::BIGINT AS bucket_y, count(*) AS polygons FROM a GROUP BY 1, 2""")
def bucketed_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many boundaries have their middle in each bucket of a tenth of a degree."""
    return overlay.bucket_by_centre(areas(spark, sf_dir))


@query(f"""
WITH t AS ({TIMES}), c AS (SELECT l_orderkey % 5 AS preset, l_suppkey AS station, l_linenumber AS ord, list_sort([l_orderkey % 4, l_linenumber % 4]) AS routes, l_orderkey AS k FROM t),
f AS (SELECT *, CASE preset WHEN 0 THEN list_filter(routes, lambda x: x IN (0, 1)) WHEN 1 THEN list_filter(routes, lambda x: x = 3) ELSE routes END AS kept FROM c),
g AS (SELECT * FROM f WHERE preset > 1 OR len(kept) > 0)
SELECT station, min(k * 10 + ord) AS place, max(k * 10 + ord) AS last FROM g GROUP BY station""")
def selected_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations of presets cut to the allowed routes: the last row of each, in the place of its first."""
    t = stop_times(spark, sf_dir)
    rows = t.select((F.col("l_orderkey") % 5).alias("preset"), F.col("l_suppkey").alias("station"), F.array_sort(F.array((F.col("l_orderkey") % 4).cast("int"), (F.col("l_linenumber") % 4).cast("int"))).alias("route_ids"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    allowed = spark.createDataFrame([(0, [0, 1]), (1, [3])], "preset long, allowed array<int>")
    kept = transit.allowed_only(rows, allowed)
    return transit.last_per_id(kept.withColumn("last", F.col("ord")), "station", "ord").select("station", "place", "last")


@query(f"""
WITH g AS (SELECT cell, 139.0::DOUBLE + (cell % 60 + 0.5) * (1.0 / 60) AS lon, 35.0::DOUBLE + (cell // 60 + 0.5) * (1.0 / 60) AS lat FROM range(3600) t(cell)), s AS ({STATIONS}),
near AS (SELECT cell, count(*) FILTER ({hav('g.lon', 'g.lat', 's.lon', 's.lat')} <= 6000) > 0 AS zone, count(*) FILTER (station % 2 = 0 AND {hav('g.lon', 'g.lat', 's.lon', 's.lat')} <= 6000) > 0 AS served FROM g, s GROUP BY cell),
d AS (SELECT g.*, zone, served, {hav('lon', 'lat', '139.4', '35.5')} AS m1, {hav('lon', 'lat', '139.7', '35.6')} AS m2, (lon - 139.5) * pow(cos(radians(35.45)), 2) * 0.2 + (lat - 35.45) * 0.1 AS side FROM g JOIN near USING (cell)),
e AS (SELECT *, zone AND m1 <= 50000 AND m2 > 20000 AND side >= 0 AND NOT served AS ok FROM d)
SELECT count(*) AS cells, count(*) FILTER (ok) AS eligible, round(sum(lon) FILTER (ok), 4) AS lons, round(sum(lat) FILTER (ok), 4) AS lats FROM e""")
def eligible_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells left by all families of a game at once: the hiding zone, a radar yes and a no, a thermometer, a transit line's no; an unanswered question takes nothing."""
    cells = elimination.cell_grid(spark, 139.0, 35.0, 140.0, 36.0, 60)
    q = [
        (1, "radar", "positive", 139.4, 35.5, 50000.0, None, None, None, None, None), (2, "radar", "negative", 139.7, 35.6, 20000.0, None, None, None, None, None), (3, "radar", "unanswered", 139.0, 35.0, 1.0, None, None, None, None, None),
        (4, "thermometer", "hotter", 139.4, 35.4, None, 139.6, 35.5, None, None, None), (5, "transit-line", "negative", None, None, None, None, None, None, None, "even"),
    ]
    questions = spark.createDataFrame(q, "ord int, type string, answer string, lon double, lat double, distance double, lon2 double, lat2 double, category string, selected long, line string")
    s = stations(spark, sf_dir).select(F.array(F.when(F.col("station") % 2 == 0, "even").otherwise("odd")).alias("route_ids"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    none = spark.createDataFrame([], "poi long, category string, name_length int, r_lon double, r_lat double")
    out = elimination.eligible(cells, families.constraints(cells, questions, none, s, 6000.0))
    ok = F.col("eligible")
    return out.agg(F.count(F.lit(1)).alias("cells"), F.count_if(ok).alias("eligible"), F.round(F.sum(F.when(ok, F.col("lon"))), 4).alias("lons"), F.round(F.sum(F.when(ok, F.col("lat"))), 4).alias("lats"))


@query("""
WITH d AS (SELECT doc_id AS k, source, n_chars, doc_id % 4 AS form FROM documents),
s AS (SELECT k, form, '{"k":"app-state","p":{"a":{"l":' || to_json(coalesce(source, 'none'))::VARCHAR || ',"n":[' || (139000000 + k * 10) || ',35500000],"o":' || k || '},"g":"g' || k || '","m":{"c":"2024"}' ||
  CASE WHEN k % 3 = 0 THEN '' ELSE ',"q":[{' || CASE WHEN k % 5 = 0 THEN '"d":"1km","du":"km",' ELSE '"d":"1km",' END || CASE k % 2 WHEN 0 THEN '"e":"p",' ELSE '' END || '"i":"q1","n":[139250000,35250000],"r":' || (k % 7 + 1) || '.5,"t":"r"}]' END || '},"v":1}' AS short FROM d)
SELECT k, length(short)::INT AS n, md5(short) AS digest, CASE form WHEN 1 THEN 'unsupported-version' WHEN 2 THEN 'invalid-json' ELSE 'ok' END AS status, CASE WHEN form = 3 THEN 'zz' WHEN form = 0 THEN '' END AS unknown, form IN (0, 3) AS same FROM s""")
def short_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States about documents as short-keyed texts and back: equal where they are whole, reported where the version, the text or a key is odd."""
    k = F.col("doc_id")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(y).alias("y"))
    question = {"id": F.lit("q1"), "questionType": F.lit("radar"), "answer": F.when(k % 2 == 0, "positive").otherwise("unanswered"), "center": at(F.lit(139.25), 35.25), "radiusMeters": k % 7 + 1.5, "radiusOption": F.lit("1km"), "distanceUnit": F.when(k % 5 == 0, "km").otherwise("m")}
    typed = lambda values, schema: F.struct(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
    q = typed(question, wire.long_schema(wire.QUESTION))
    none = F.array().cast(T.ArrayType(wire.long_schema(wire.QUESTION)))
    area = typed({"center": at((139000000 + k * 10) / 1000000, 35.5), "label": F.coalesce("source", F.lit("none")), "osmId": k}, wire.long_schema(wire.STATE["playArea"]))
    state_ = {"gameId": F.concat(F.lit("g"), k.cast("string")), "metadata": F.struct(F.lit("2024").alias("createdAt")), "playArea": area, "questions": F.when(k % 3 == 0, none).otherwise(F.array(q))}
    d = table(spark, sf_dir, "documents").select(k.alias("k"), typed(state_, wire.long_schema()).alias("state"), (k % 4).alias("form"))
    d = d.withColumn("short", wire.minify(F.col("state")))
    odd = F.when(F.col("form") == 1, F.regexp_replace("short", '"v":1', '"v":2')).when(F.col("form") == 2, F.substring("short", 1, 9)).when(F.col("form") == 3, F.concat(F.lit('{"zz":1,'), F.substring("short", 2, 1 << 20))).otherwise(F.col("short"))
    out = wire.unminify(d.withColumn("text", odd), "text")
    return out.select("k", F.length("short").alias("n"), F.md5("short").alias("digest"), "status", F.array_join("unknown", ",").alias("unknown"), F.coalesce(F.to_json("payload") == F.to_json("state"), F.lit(False)).alias("same"))


@query(f"""
WITH g AS (SELECT cell, 139.0::DOUBLE + (cell % 50 + 0.5) * (1.0 / 50) AS x, 35.0::DOUBLE + (cell // 50 + 0.5) * (1.0 / 50) AS y FROM range(2500) t(cell)), s AS ({STATIONS}), p AS (SELECT c_custkey AS poi, c_mktsegment AS category, {pos('c_custkey')} FROM customer),
n AS (SELECT cell, arg_min(poi, (round(pow(x - lon, 2) + pow(y - lat, 2), 14), poi)) AS poi FROM g, p WHERE category = 'BUILDING' GROUP BY cell),
l AS (SELECT cell, arg_min(station, (round(pow(x - lon, 2) + pow(y - lat, 2), 14), station)) AS station, min({hav('x', 'y', 'lon', 'lat')}) <= 15000 AS zone FROM g, s GROUP BY cell),
f AS (SELECT cell, min({hav('x', 'y', 'lon', 'lat')}) FILTER (category = 'FURNITURE') AS mf, min({hav('x', 'y', 'lon', 'lat')}) FILTER (category = 'HOUSEHOLD') AS mh FROM g, p GROUP BY cell),
k AS (SELECT min({hav('139.3', '35.3', 'lon', 'lat')}) FILTER (category = 'FURNITURE') AS df, min({hav('139.31', '35.72', 'lon', 'lat')}) FILTER (category = 'HOUSEHOLD') AS dh,
  min(poi) FILTER (category = 'BUILDING') AS selected, count(*) FILTER (category = 'MACHINERY' AND {hav('139.5', '35.5', 'lon', 'lat')} <= 15000) > 0 AS held FROM p),
e AS (SELECT x, y, zone AND n.poi <> selected AND station % 3 = 1 AND NOT (held AND {hav('x', 'y', '139.5', '35.5')} <= 15000) AND (df = 0 OR mf <= df) AND (dh = 0 OR mh > dh) AS ok FROM g JOIN n USING (cell) JOIN l USING (cell) JOIN f USING (cell), k)
SELECT count(*) AS cells, count(*) FILTER (ok) AS eligible, round(coalesce(sum(x) FILTER (ok), 0), 4) AS lons, round(coalesce(sum(y) FILTER (ok), 0), 4) AS lats FROM e""")
def eligible_by_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells left by questions about places: not nearest to one building, nearest to a station whose name is as long, outside the tentacles' disc, closer to furniture and further from households than the seeker."""
    cells = elimination.cell_grid(spark, 139.0, 35.0, 140.0, 36.0, 50)
    p = placed(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("poi"), F.col("c_mktsegment").alias("category"), F.lit(0).alias("name_length")), "poi", "r_lon", "r_lat")
    s = stations(spark, sf_dir).select(F.col("station").cast("long").alias("poi"), F.lit("station-name-length").alias("category"), (F.col("station") % 3).cast("int").alias("name_length"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    first = p.filter("category = 'BUILDING'").agg(F.min("poi")).first()[0]
    q = [
        (1, "matching", "negative", None, None, None, None, None, "BUILDING", first, None), (2, "matching", "positive", None, None, None, None, None, "station-name-length", 1, None),
        (3, "tentacles", "negative", 139.5, 35.5, 15000.0, None, None, "MACHINERY", None, None), (4, "measuring", "closer", 139.3, 35.3, None, None, None, "FURNITURE", None, None),
        (5, "measuring", "further", 139.31, 35.72, None, None, None, "HOUSEHOLD", None, None),
    ]
    questions = spark.createDataFrame(q, "ord int, type string, answer string, lon double, lat double, distance double, lon2 double, lat2 double, category string, selected long, line string")
    zones = s.select(F.array(F.lit("any")).alias("route_ids"), "r_lon", "r_lat")
    out = elimination.eligible(cells, families.constraints(cells, questions, p.unionByName(s), zones, 15000.0))
    ok = F.col("eligible")
    total = lambda c, name: F.round(F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0.0)), 4).alias(name)
    return out.agg(F.count(F.lit(1)).alias("cells"), F.count_if(ok).alias("eligible"), total("lon", "lons"), total("lat", "lats"))
