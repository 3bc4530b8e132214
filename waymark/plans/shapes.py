"""Queries: exact overlay, dissolve, repair and buffers of polygons, with closed forms and coordinate grids as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import arrangement, artifact_jobs, cells_of, equals
from waymark.plans.registry import pos, query
from waymark.plans.spatial import STATIONS, areas
from waymark.session import pois, shared_folder, stations, table

#: Diamonds around stations: half a diagonal, in degrees.
HALF = 0.0625
#: A tenth of a millimetre: edges of up to a degree.
FINE = 1e-9


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def diamonds(df: DataFrame, half: float = HALF) -> DataFrame:
    x, y = F.col("lon"), F.col("lat")
    ring = F.array(*(_point(x + dx * half, y + dy * half) for dx, dy in ((-1, 0), (0, -1), (1, 0), (0, 1), (-1, 0))))
    return df.withColumn("multi", F.array(F.array(ring)))


#: In u = x + y, v = x - y diamonds are squares of twice the half diagonal; lines through all sides cut the plane into boxes
#: that a diamond covers whole or not at all. One unit of du dv is half a unit of area.
BOXES = f"""
WITH s AS ({STATIONS}), d AS (SELECT station, operator % 5 AS k, round(lon + lat, 4) AS u, round(lon - lat, 4) AS v FROM s),
us AS (SELECT k, u, lead(u) OVER (PARTITION BY k ORDER BY u) AS u2 FROM (SELECT DISTINCT k, round(u + h, 4) AS u FROM d, (VALUES (-{HALF}::DOUBLE), ({HALF}::DOUBLE)) t(h))),
vs AS (SELECT k, v, lead(v) OVER (PARTITION BY k ORDER BY v) AS v2 FROM (SELECT DISTINCT k, round(v + h, 4) AS v FROM d, (VALUES (-{HALF}::DOUBLE), ({HALF}::DOUBLE)) t(h))),
c AS (SELECT us.k, us.u, us.u2, vs.v, vs.v2, row_number() OVER (PARTITION BY us.k, vs.v ORDER BY us.u) AS i, row_number() OVER (PARTITION BY us.k, us.u ORDER BY vs.v) AS j, bool_or(d.station % 2 = 0) AS a, bool_or(d.station % 2 = 1) AS b
  FROM us JOIN vs USING (k) JOIN d ON d.k = us.k AND abs((us.u + us.u2) / 2 - d.u) < {HALF} AND abs((vs.v + vs.v2) / 2 - d.v) < {HALF} GROUP BY 1, 2, 3, 4, 5),
cells AS (SELECT c.k, c.u, c.u2, c.v, c.v2, a, b, iu, iv, (u2 - u) * (v2 - v) / 2 AS m
  FROM (SELECT k, u, u2, v, v2, a, b FROM c) c JOIN (SELECT k, u, row_number() OVER (PARTITION BY k ORDER BY u) AS iu FROM us) USING (k, u) JOIN (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) AS iv FROM vs) USING (k, v))"""


@query(f"""{BOXES}
SELECT k::BIGINT AS k, round(sum(m), 8) AS joined, round(coalesce(sum(m) FILTER (a AND b), 0), 8) AS common, round(coalesce(sum(m) FILTER (a AND NOT b), 0), 8) AS first_only, round(coalesce(sum(m) FILTER (a <> b), 0), 8) AS one_only
FROM cells GROUP BY k""")
def exact_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diamonds around stations with even and with odd keys, overlaid exactly within each fifth of the operators."""
    s = diamonds(stations(spark, sf_dir)).withColumn("k", F.col("operator") % 5)
    both = arrangement.arranged_pair(s.filter("station % 2 = 0"), s.filter("station % 2 = 1"), ["k"])
    out = s.select("k").distinct()
    for name, rule in (("joined", arrangement.union), ("common", arrangement.intersection), ("first_only", arrangement.difference), ("one_only", arrangement.symmetric_difference)):
        part = arrangement.areas(arrangement.select(both, ["k"], rule), ["k"]).select("k", F.round("area", 8).alias(name))
        out = out.join(part, "k", "left")
    return out.na.fill(0.0)


@query(f"""{BOXES},
corners AS (SELECT DISTINCT k, iu + di AS x, iv + dj AS y FROM cells, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(di, dj)),
sides AS (SELECT DISTINCT k, iu + di AS x, iv + dj AS y, way FROM cells, (VALUES (0, 0, 'v'), (1, 0, 'v'), (0, 0, 'h'), (0, 1, 'h')) t(di, dj, way)),
e AS (SELECT k, sum(n) AS euler FROM (SELECT k, count(*) AS n FROM cells GROUP BY k UNION ALL SELECT k, count(*) FROM corners GROUP BY k UNION ALL SELECT k, -count(*) FROM sides GROUP BY k) GROUP BY k)
SELECT k::BIGINT AS k, round(sum(m), 8) AS area, any_value(euler)::BIGINT AS parts_less_holes FROM cells JOIN e USING (k) GROUP BY k""")
def dissolved_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygons that diamonds around stations dissolve into, within each fifth of the operators: their area, and how many there are less their holes."""
    s = diamonds(stations(spark, sf_dir)).withColumn("k", F.col("operator") % 5)
    p = arrangement.polygons(arrangement.dissolve(s, ["k"]), ["k"])
    return p.groupBy("k").agg(F.round(F.sum("area"), 8).alias("area"), F.sum(2 - F.size("polygon")).cast("long").alias("parts_less_holes"))


@query(f"""
WITH p AS (SELECT c_custkey AS k, {pos('c_custkey')} FROM customer), q AS (SELECT a.k, a.lon, a.lat, b.lon AS lon2, b.lat AS lat2 FROM p a JOIN p b ON b.k = a.k + 1),
l AS (SELECT k, sqrt(pow((lon2 - lon) * 111320 * cos(radians((lat + lat2) / 2)), 2) + pow((lat2 - lat) * 111320, 2)) AS m FROM q)
SELECT k, round((2 * 500 * m + 16 * 500.0 * 500 * sin(radians(11.25))) / 1e6, 1) AS km2, 1 AS parts FROM l""")
def buffered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 500 m buffer around the way from each customer to the next, as geometry: twice the radius by the length, and the round ends."""
    p = pois(spark, sf_dir).select(F.col("poi").alias("k"), "lon", "lat")
    after = p.select((F.col("k") - 1).alias("k"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    lines = p.join(after, "k").select("k", F.array(_point(F.col("lon"), F.col("lat")), _point(F.col("lon2"), F.col("lat2"))).alias("line"), ((F.col("lat") + F.col("lat2")) / 2).alias("mid"))
    rings_of = lambda d: arrangement.ring_rows(arrangement.buffers(d, ["k"], 500.0, grid=FINE), ["k"], FINE)
    r = equals.once(lines, ["k"], ["line"], lambda d: rings_of(d).groupBy("k").agg(F.sum("area").alias("area"), F.count(F.lit(1)).cast("int").alias("parts")))
    scale = 111320.0 * 111320.0 / 1e6
    return r.join(lines.select("k", "mid"), "k").select("k", F.round(F.col("area") * scale * F.cos(F.radians("mid")), 1).alias("km2"), "parts")


@query(f"""
WITH s AS ({STATIONS})
SELECT station, round(CASE station % 3 WHEN 0 THEN 0.0050 WHEN 1 THEN 0.0100 ELSE 0.0075 END::DOUBLE, 9) AS area, CASE station % 3 WHEN 0 THEN 2 ELSE 1 END AS parts FROM s""")
def repaired_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid rings around stations made valid: bow ties fall into two lobes, spikes go, and of a square drawn over its own quarter the rest stays."""
    x, y = F.col("lon"), F.col("lat")
    ring = lambda *ps: F.array(*(_point(x + dx, y + dy) for dx, dy in ps))
    bow = ring((0, 0), (0.1, 0.1), (0.1, 0), (0, 0.1), (0, 0))
    spike = ring((0, 0), (0.1, 0), (0.1, 0.04), (0.17, 0.04), (0.1, 0.04), (0.1, 0.1), (0, 0.1), (0, 0))
    twice = ring((0, 0), (0.05, 0), (0.05, 0.05), (0, 0.05), (0, 0), (0.1, 0), (0.1, 0.1), (0, 0.1), (0, 0))
    s = stations(spark, sf_dir).withColumn("multi", F.array(F.array(F.when(F.col("station") % 3 == 0, bow).when(F.col("station") % 3 == 1, spike).otherwise(twice))))
    parts = lambda d: arrangement.polygons(arrangement.repair(d, ["station"]), ["station"])
    return equals.once(s, ["station"], ["multi"], lambda d: parts(d).groupBy("station").agg(F.round(F.sum("area"), 9).alias("area"), F.count(F.lit(1)).cast("int").alias("parts")))


@query(f"""
WITH s AS ({STATIONS}), m AS (SELECT station, 0.1 * 111320 * cos(radians(lat)) AS w, 0.1 * 111320 AS h FROM s)
SELECT station, round((w * h + 2 * 1000 * (w + h) + 16 * 1000.0 * 1000 * sin(radians(11.25))) / 1e6, 1) AS km2 FROM m""")
def dilated_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Play areas (squares around stations) grown by 1 km, with round corners."""
    x, y = F.col("lon"), F.col("lat")
    ring = F.array(*(_point(x + dx * 0.05, y + dy * 0.05) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))))
    s = stations(spark, sf_dir).withColumn("multi", F.array(F.array(ring)))
    a = equals.once(s, ["station"], ["multi"], lambda d: arrangement.areas(arrangement.dilate(d, ["station"], 1000.0, grid=FINE), ["station"], FINE))
    return a.join(s.select("station", "lat"), "station").select("station", F.round(F.col("area") * (111320.0 * 111320.0 / 1e6) * F.cos(F.radians("lat")), 1).alias("km2"))


#: A lattice of customers, and the corner that is cut out of each question's play area.
LATTICE = "SELECT c_custkey // 100 AS question, c_custkey AS poi, (c_custkey % 100) % 10 AS i, (c_custkey % 100) // 10 AS j FROM customer"


@query(f"""
WITH p AS ({LATTICE}), n AS (SELECT question FROM p GROUP BY question HAVING count(*) = 100),
c AS (SELECT p.*, CASE WHEN i = 0 THEN 0.0 ELSE 0.1 * i + 0.0 END AS w, CASE WHEN i = 9 THEN 1.0 ELSE 0.1 * i + 0.1 END AS e, CASE WHEN j = 0 THEN 0.0 ELSE 0.1 * j END AS s, CASE WHEN j = 9 THEN 1.0 ELSE 0.1 * j + 0.1 END AS n FROM p JOIN n USING (question)),
a AS (SELECT question, poi, (e - w) * (n - s) - greatest(0, e - greatest(w, 0.33)) * greatest(0, n - greatest(s, 0.47)) AS area FROM c)
SELECT question, poi, round(area::DOUBLE, 8) AS area FROM a WHERE area > 1e-9""")
def concave_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voronoi cells of lattices of a hundred customers within a play area that lacks a corner: the area of each."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(F.floor(k / 100).alias("question"), k.alias("poi"), (F.lit(139.05) + k % 10 * 0.1).alias("lon"), (F.lit(35.05) + F.floor(k % 100 / 10) * 0.1).alias("lat"))
    full = c.groupBy("question").agg(F.count(F.lit(1)).alias("n")).filter("n = 100").select("question")
    corners = ((0, 0), (1, 0), (1, 0.47), (0.33, 0.47), (0.33, 1), (0, 1), (0, 0))
    shapes = full.withColumn("multi", F.array(F.array(F.array(*(_point(F.lit(139.0 + x), F.lit(35.0 + y)) for x, y in corners)))))
    cells = cells_of.voronoi(c.join(full, "question", "left_semi"), "question", "poi", (139.0, 35.0, 140.0, 36.0))
    both = cells.join(shapes, "question")
    key = ["question", "poi"]

    def clipped(d: DataFrame) -> DataFrame:
        edges = cells_of.clipped_pairs(d, key)
        return arrangement.areas(edges, key)

    return equals.once(both, key, ["cell", "multi"], clipped).select(*key, F.round("area", 8).alias("area"))


@query("""
SELECT 'boundaries' AS kind, count(*) AS rows, true AS written, false AS again FROM nation
UNION ALL SELECT 'measuring', (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier), true, false""")
def built_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries and measuring lines of a region built, and asked for again with their rows in another order: the second time nothing is written."""
    a = areas(spark, sf_dir)
    x, y = F.col("lon"), F.col("lat")
    lines = stations(spark, sf_dir).select(F.lit("rail").alias("category"), F.col("station").cast("string").alias("id"), F.array(_point(x, y), _point(x + 0.01, y)).alias("line"))
    folder, runs = shared_folder(spark, "region"), []
    for areas_, lines_ in ((a, lines), (a.orderBy(F.desc("area")), lines.repartition(3))):
        runs.append(artifact_jobs.report(spark, {
            "boundaries": artifact_jobs.resumed(folder, "boundaries", {"areas": areas_}, lambda: artifact_jobs.boundaries(a)),
            "measuring": artifact_jobs.resumed(folder, "measuring", {"areas": areas_, "lines": lines_}, lambda: artifact_jobs.measuring_lines(a, lines)),
        }))
    return runs[0].join(runs[1].select("kind", F.col("rows").alias("rows2"), F.col("written").alias("again")), "kind").filter("rows = rows2").select("kind", "rows", "written", "again")
