"""Queries: streets stitched through junctions, one of parallel tracks, lines joined across gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import rings
from waymark.operators import line_builder, strands
from waymark.plans.registry import hav, query
from waymark.plans.spatial import STATIONS
from waymark.plans.transit import TIMES, stop_times
from waymark.session import stations, table


@query("""
WITH RECURSIVE c AS (SELECT c_custkey AS k, c_custkey % 40 AS i, c_custkey // 40 AS j FROM customer),
w AS (SELECT 2 * k AS way, i, j, i + 1 AS i2, j AS j2, 'E' AS d, 'W' AS d2 FROM c WHERE k % 7 <> 0 UNION ALL SELECT 2 * k + 1, i, j, i, j + 1, 'N', 'S' FROM c WHERE k % 5 <> 0),
s AS (SELECT i, j, way, d FROM w UNION ALL SELECT i2, j2, way, d2 FROM w),
n AS (SELECT i, j, count(*) AS degree, list(way ORDER BY way) AS ways, max(way) FILTER (d = 'E') AS e, max(way) FILTER (d = 'W') AS w, max(way) FILTER (d = 'N') AS n, max(way) FILTER (d = 'S') AS s FROM s GROUP BY i, j),
l AS (SELECT ways[1] AS a, ways[2] AS b FROM n WHERE degree = 2 UNION ALL SELECT e, w FROM n WHERE degree > 2 AND e IS NOT NULL AND w IS NOT NULL UNION ALL SELECT n, s FROM n WHERE degree > 2 AND n IS NOT NULL AND s IS NOT NULL),
l2 AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT way AS root, way FROM w UNION SELECT r.root, l2.b FROM r JOIN l2 ON l2.a = r.way)
SELECT first, count(*)::INT AS ways, (count(*) + 1)::INT AS points FROM (SELECT way, min(root) AS first FROM r GROUP BY way) GROUP BY first""")
def stitched_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets of a grid, one or two a customer, as maximal lines that go straight on at junctions and round corners without one."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k, (k % 40).alias("i"), F.floor(k / 40).alias("j"))
    at = lambda i, j: F.struct((F.lit(139.0) + i * 0.01).alias("x"), (F.lit(35.0) + j * 0.001).alias("y"))
    i, j = F.col("i"), F.col("j")
    east = c.filter(k % 7 != 0).select((2 * k).cast("long").alias("way"), F.array(at(i, j), at(i + 1, j)).alias("line"))
    north = c.filter(k % 5 != 0).select((2 * k + 1).cast("long").alias("way"), F.array(at(i, j + 1), at(i, j)).alias("line"))
    return strands.stitch_segments(east.unionByName(north)).select("first", "ways", F.size("line").alias("points"))


@query("""
WITH RECURSIVE t AS (SELECT s_suppkey AS k, s_suppkey // 5 AS c, s_suppkey % 5 AS r, 1000 + 100 * (s_suppkey * 7 % 11) AS m FROM supplier),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY m DESC, k) AS n FROM t),
f AS (SELECT c, n, [r] AS kept, [k] AS keys FROM o WHERE n = 1
  UNION ALL SELECT o.c, o.n, CASE WHEN len(list_filter(f.kept, lambda x: abs(x - o.r) <= 2)) > 0 THEN f.kept ELSE list_append(f.kept, o.r) END,
    CASE WHEN len(list_filter(f.kept, lambda x: abs(x - o.r) <= 2)) > 0 THEN f.keys ELSE list_append(f.keys, o.k) END FROM f JOIN o ON o.c = f.c AND o.n = f.n + 1)
SELECT unnest(keys) AS way FROM (SELECT c, arg_max(keys, n) AS keys FROM f GROUP BY c)""")
def kept_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks 12 m apart, five a corridor and of several lengths: the longest stay, and what runs within 30 m of one that stays goes."""
    k = F.col("s_suppkey")
    y = F.lit(35.0) + F.floor(k / 5) % 3000 * 0.01 + k % 5 * (12 / 111320)
    x0 = F.lit(130.0) + F.floor(k / 15000) * 0.5
    size = (1000 + 100 * (k * 7 % 11)) / (111320 * F.cos(F.radians(F.lit(35.0) + F.floor(k / 5) % 3000 * 0.01)))
    s = table(spark, sf_dir, "supplier").select(k.cast("long").alias("way"), y.alias("y"), x0.alias("x0"), size.alias("size"))
    points = [F.struct((F.col("x0") + F.col("size") * f).alias("x"), F.col("y")) for f in (0.0, 0.25, 0.5, 0.75, 1.0)]
    line = F.when(F.col("way") % 2 == 0, F.array(*points)).otherwise(F.array(*points[::-1]))
    return strands.drop_parallel(s.select("way", line.alias("line")), "way").select("way")


@query(f"""
WITH l AS (SELECT s_suppkey AS k, s_suppkey // 10 AS j, 139.0::DOUBLE + s_suppkey % 10 * 0.03 AS x, 35.0::DOUBLE + s_suppkey // 10 * 0.02 AS y, 0.01::DOUBLE + (s_suppkey * 13 % 10) * 0.0019 AS size FROM supplier),
g AS (SELECT *, lag(k) OVER w AS before, {hav('lag(x + size) OVER w', 'y', 'x', 'y')} AS m FROM l WINDOW w AS (PARTITION BY j ORDER BY k)),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR m > 1500 THEN 1 ELSE 0 END) OVER (PARTITION BY j ORDER BY k) AS run FROM g)
SELECT min(k) AS first, count(*)::INT AS ways, (2 * count(*))::INT AS points, round({hav('min(x)', 'min(y)', 'max(x + size)', 'max(y)')}, 0) AS m FROM r GROUP BY j, run""")
def bridged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in rows with gaps of 260 to 1,800 m, joined across those of up to 1,500 m.

    Rows go north with the keys: near a pole gaps shrink to nothing and are joined all the same, so the operator's least gap
    of 1 m doesn't hold here.
    """
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.cast("long").alias("way"), (F.lit(139.0) + k % 10 * 0.03).alias("x"), (F.lit(35.0) + F.floor(k / 10) * 0.02).alias("y"), (F.lit(0.01) + k * 13 % 10 * 0.0019).alias("size"))
    ends = [F.struct("x", "y"), F.struct((F.col("x") + F.col("size")).alias("x"), "y")]
    line = F.when(F.col("way") % 3 == 0, F.array(*ends[::-1])).otherwise(F.array(*ends))
    out = strands.bridge_gaps(s.select("way", line.alias("line")), least_m=0.0)
    e = lambda i: F.element_at("line", i)
    whole = F.transform(F.array(F.lit(0)), lambda _: F.array(e(1), e(-1)))
    return out.withColumn("across", F.get(whole, F.lit(0))).select("first", "ways", F.size("line").alias("points"), F.round(rings.length_m(F.col("across")), 0).alias("m"))


@query(f"""
WITH s AS (SELECT *, min(station) OVER (PARTITION BY lon, lat) AS first_here FROM ({STATIONS})), o AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 3 = 0 THEN -o_custkey - 1 ELSE o_orderkey END AS line, o_custkey % 3 = 0 AS mastered FROM orders),
m AS (SELECT l_orderkey AS k, l_linenumber AS seq, l_suppkey AS spot, (l_orderkey + 3 * l_linenumber) % 4 AS way FROM ({TIMES}) WHERE l_linenumber % 4 <> 3),
r AS (SELECT m.k, m.seq, m.way, m.spot, s.station, s.first_here FROM m LEFT JOIN s ON s.station = m.spot),
f AS (SELECT k, seq, CASE way WHEN 0 THEN station WHEN 1 THEN first_here WHEN 2 THEN spot % 17 END AS station FROM r),
g AS (SELECT o.line, f.k, CASE WHEN f.station IN (SELECT station FROM s) THEN f.station END AS station FROM f JOIN o USING (k)),
b AS (SELECT line, count(*) FILTER (n >= 2) AS branches FROM (SELECT g.line, g.k, count(DISTINCT (lon, lat)) AS n FROM g JOIN s ON s.station = g.station GROUP BY 1, 2) GROUP BY line),
l AS (SELECT o.line, any_value(mastered) AS mastered, count(DISTINCT o.k) AS variants FROM o GROUP BY o.line),
n AS (SELECT line, count(DISTINCT station) AS stations, count(*) FILTER (station IS NULL) AS unresolved FROM g GROUP BY line)
SELECT l.line, mastered, coalesce(stations, 0)::INT AS stations, coalesce(branches, 0)::INT AS branches, coalesce(unresolved, 0)::INT AS unresolved,
  CASE WHEN coalesce(stations, 0) < 2 THEN 'too few stations' WHEN coalesce(branches, 0) = 0 THEN 'no geometry' END AS reason
FROM l LEFT JOIN n USING (line) LEFT JOIN b USING (line)""")
def built_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as routes, those of every third customer as variants of a master's line: items are members, found by id, place or name."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("relation"), "o_custkey")
    tags = F.create_map(F.lit("route"), F.lit("train"), F.lit("name"), F.concat(F.lit("line "), F.col("relation").cast("string")))
    routes = o.select("relation", tags.alias("tags"))
    masters = o.filter("o_custkey % 3 = 0").groupBy((-F.col("o_custkey") - 1).cast("long").alias("relation")).agg(F.collect_list("relation").alias("members")).withColumn("tags", tags)
    seq, at = F.col("l_linenumber"), F.col("l_suppkey").cast("long")
    way = (F.col("l_orderkey") + 3 * seq) % 4
    role = F.when(seq % 4 == 3, "platform").when(seq % 4 == 1, "stop").otherwise("stop_exit_only")
    s = stations(spark, sf_dir)
    known = s.select(F.col("station").cast("long").alias("l_at"), "lon", "lat")
    li = stop_times(spark, sf_dir).withColumn("l_at", at).join(known, "l_at", "left")
    here = lambda v: F.when((way == 1), F.col(v))
    members = li.select(
        F.col("l_orderkey").cast("long").alias("relation"), seq.cast("int").alias("seq"), F.lit("node").alias("type"), F.when(way == 0, at).otherwise(-at - 1).alias("ref"), role.alias("role"),
        F.when(way == 2, F.concat(F.lit("n"), F.col("l_at") % 17)).alias("name_key"), here("lon").alias("lon"), here("lat").alias("lat"),
    )
    name = F.concat(F.lit("n"), F.col("station"))
    places = s.select(F.col("station").cast("long").alias("station"), name.alias("name_key"), F.lit("station").alias("kind"), F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"))
    out = line_builder.build_lines(routes, masters, members, places, cluster_m=20.0)
    return out.select("line", "mastered", F.size("stations").alias("stations"), F.when(F.col("geometry").isNull(), 0).otherwise(F.size("geometry")).alias("branches"), "unresolved", "reason")
