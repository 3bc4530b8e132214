"""Scalar functions, rings, kernels and codecs against plain Python on small literals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, kernels, rings
from waymark.functions import text as tx


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def pt(x, y):
    return {"x": float(x), "y": float(y)}


SQUARE = [pt(0, 0), pt(4, 0), pt(4, 4), pt(0, 4), pt(0, 0)]
HOLE = [pt(1, 1), pt(1, 3), pt(3, 3), pt(3, 1), pt(1, 1)]


def geometries(spark, rows):
    return spark.createDataFrame(rows, f"k int, multi {kernels.MULTI.simpleString()}")


def test_distances_are_null_for_null(spark):
    r = one(spark, a=geo.haversine_m(F.lit(None).cast("double"), 0.0, 1.0, 1.0), b=geo.haversine_m(0.0, 0.0, 180.0, 0.0), c=geo.haversine_m(1.0, 1.0, 1.0, 1.0))
    assert r["a"] is None and abs(r["b"] - math.pi * geo.EARTH_M) < 1e-3 and r["c"] == 0


def test_rounding_halves_go_up(spark):
    r = one(spark, a=geo.js_round(-0.5), b=geo.js_round(2.5), c=geo.quantize(-0.000005))
    assert (r["a"], r["b"], r["c"]) == (0.0, 3.0, 0)


def test_units(spark):
    r = one(spark, a=geo.to_metres(F.lit("1.5"), F.lit("km")), b=geo.to_metres(F.lit("-1"), F.lit("m")), c=geo.to_metres(F.lit("x"), F.lit("m")), d=geo.to_metres(F.lit("1"), F.lit("ft")), e=geo.from_metres(1609.344, F.lit("mi")), f=geo.from_metres(12345.0, F.lit("km")), g=geo.from_metres(1234.0, F.lit("km")))
    assert r["a"] == 1500 and r["b"] is None and r["c"] is None and r["d"] is None and (r["e"], r["f"], r["g"]) == ("1", "12.3", "1.23")


def test_circle_box_holds_the_circle(spark):
    r = one(spark, box=geo.circle_box(139.5, 35.5, 5000.0), x=geo.destination(139.5, 35.5, 90.0, 5000.0)[0], pole=geo.circle_box(0.0, 89.99, 5000.0))
    assert r["box"]["w"] < 139.5 and r["box"]["e"] > r["x"] and (r["pole"]["w"], r["pole"]["e"], r["pole"]["n"]) == (-180.0, 180.0, 90.0)


def test_clip_segment(spark):
    box = geo.bbox(0.0, 0.0, 1.0, 1.0)
    a, b = geo.clip_segment(-1.0, 0.5, 2.0, 0.5, box)
    c, d = geo.clip_segment(-1.0, 5.0, 2.0, 5.0, box)
    r = one(spark, a=a, b=b, c=c, d=d)
    assert abs(r["a"] - 1 / 3) < 1e-12 and abs(r["b"] - 2 / 3) < 1e-12 and r["c"] is None and r["d"] is None


def test_polygons_with_holes(spark):
    df = geometries(spark, [(1, [[SQUARE, HOLE]]), (2, []), (3, [[SQUARE[:3]]])])
    m = F.col("multi")
    r = {x["k"]: x for x in df.select("k", rings.point_in_multipolygon(2.0, 2.0, m).alias("hole"), rings.point_in_multipolygon(0.5, 0.5, m).alias("ring"), rings.count_points(m).alias("n"), rings.sanity(m).alias("s")).collect()}
    assert (r[1]["hole"], r[1]["ring"], r[1]["n"], r[1]["s"]["unclosed"]) == (False, True, 10, 0)
    assert (r[2]["hole"], r[2]["n"]) == (False, 0) and r[3]["s"]["unclosed"] == 1


def test_areas(spark):
    df = geometries(spark, [(1, [[SQUARE, HOLE]])]).withColumn("polygon", F.col("multi")[0])
    r = df.select(rings.polygon_planar_area(F.col("polygon")).alias("flat"), rings.polygon_area_m2(F.col("polygon")).alias("m2"), rings.polygon_perimeter_m(F.col("polygon")).alias("m")).first()
    assert r["flat"] == 12 and abs(r["m2"] / (12 * 111319.49**2) - 1) < 0.01 and r["m"] > 24 * 110000


def test_delta_round_trip(spark):
    multi = [[[pt(-1.23456, 2.0), pt(-1.0, 2.5), pt(-0.5, 2.25), pt(-1.23456, 2.0)]], [SQUARE, HOLE]]
    df = geometries(spark, [(1, multi), (2, [])]).withColumn("code", rings.delta_encode(F.col("multi")))
    for r in df.withColumn("back", kernels.decode_delta("code")).collect():
        want = multi if r["k"] == 1 else []
        assert [[[(p["x"], p["y"]) for p in ring] for ring in poly] for poly in r["back"]] == [[[(p["x"], p["y"]) for p in ring] for ring in poly] for poly in want]
    with pytest.raises(Exception, match="fewer than 3"):
        geometries(spark, [(1, [[SQUARE[:2]]])]).select(rings.delta_encode(F.col("multi"))).collect()
    with pytest.raises(ValueError):
        kernels.delta_decode([1, 1, 2, 0, 0, 1, 1])


def test_compact_line(spark):
    df = spark.createDataFrame([([pt(139.123456, -35.5), pt(139.2, -35.25), pt(139.0, -35.0)],), ([],)], f"line {kernels.LINE.simpleString()}")
    rows = df.withColumn("code", rings.compact_line(F.col("line"))).withColumn("back", rings.expand_line(F.col("code"))).collect()
    assert rows[0]["back"] == rows[0]["line"] and rows[0]["code"][2] == 3 and rows[1]["code"] == [] and rows[1]["back"] == []


def test_wkb_round_trip_and_bad_input():
    poly = [[pt(0, 0), pt(1, 0), pt(1, 1), pt(0, 0)]]
    assert kernels.read_wkb(kernels.wkb("MultiPolygon", [poly, poly])) == [poly, poly]
    raw = kernels.wkb("Polygon", poly)
    assert len(raw) == 1 + 4 + 4 + 4 + 64 and kernels.read_wkb(raw) == [poly]
    for bad in (raw[:-1], raw[:3], b"", raw[:1] + b"\x63\0\0\0" + raw[5:]):
        with pytest.raises(ValueError):
            kernels.read_wkb(bad)


def test_simplify_keeps_within_tolerance():
    rng = np.random.default_rng(1)
    xy = np.column_stack([np.linspace(0, 1, 400), np.cumsum(rng.normal(0, 0.01, 400))])
    kept = kernels.simplify_xy(xy, 0.02)
    assert kept[0] == 0 and kept[-1] == 399 and len(kept) < 200
    for a, b in zip(kept, kept[1:]):
        p, d = xy[a], xy[b] - xy[a]
        t = np.clip(((xy[a : b + 1] - p) @ d) / (d @ d), 0, 1)
        assert np.hypot(*(xy[a : b + 1] - p - t[:, None] * d).T).max() <= 0.02 + 1e-12
    assert len(kernels.simplify_xy(np.column_stack([np.zeros(50_000), np.arange(50_000.0)]), 1e-9)) == 2


def test_voronoi_membership_matches_nearest():
    rng = np.random.default_rng(2)
    pts = rng.random((40, 2))
    cells = kernels.voronoi([tuple(p) for p in pts], (0, 0, 1, 1))
    xy = [np.array([(p["x"], p["y"]) for p in c])[:-1] for c in cells]
    assert abs(sum(abs(kernels._area(c)) for c in xy) - 1) < 1e-9
    for q in rng.random((300, 2)):
        k = int(np.hypot(*(pts - q).T).argmin())
        a, b = xy[k], np.roll(xy[k], -1, axis=0)
        side = (b - a)[:, 0] * (q - a)[:, 1] - (b - a)[:, 1] * (q - a)[:, 0]
        assert (side >= -1e-9).all() or (side <= 1e-9).all()


def test_line_buffer_covers(spark):
    df = spark.createDataFrame([([pt(139.5, 35.5), pt(139.52, 35.51)],)], f"line {kernels.LINE.simpleString()}").withColumn("zone", kernels.line_buffer(1000.0)("line"))
    r = df.select(*(rings.point_in_multipolygon(139.51 + dx, 35.505 + dy, F.col("zone")).alias(n) for n, dx, dy in (("mid", 0, 0), ("near", 0, 0.008), ("far", 0, 0.02)))).first()
    assert (r["mid"], r["near"], r["far"]) == (True, True, False)


def test_names(spark):
    df = spark.createDataFrame([("Île-de-France",), ("Ｔōkyō  駅",), ("新宿駅",), (None,)], "n string")
    assert [r[0] for r in df.select(tx.search_key("n")).collect()] == ["ile-de-france", "tokyo  駅", "新宿駅", None]
    assert [r[0] for r in df.select(tx.station_key(F.col("n"), ["駅", "station"])).collect()] == ["île-de-france", "tōkyō", "新宿", None]


@pytest.mark.parametrize(
    "raw,key", [("Train Red Line (Inbound)", "red line"), ("Blue Line: A → B", "blue line: a"), ("山手線 上り", "山手線"), ("Green - Northbound 12", "green - northbound"), ("Gold Line - North", "gold line"), ("Line 7 outbound", "line")]
)
def test_line_keys(spark, raw, key):
    assert one(spark, k=tx.line_key(F.lit(raw)))["k"] == key


def test_colours_slugs_and_lengths(spark):
    r = one(spark, red=tx.hsl_hex(F.lit(0.0), 1.0, 0.5), green=tx.hsl_hex(F.lit(120.0), 1.0, 0.5), h=tx.hash_hue(F.lit("abc")), s=tx.slug(F.lit("Tokyo Metro!")), t=tx.slug(F.lit("東京")), n=tx.utf16_length(F.lit("a😀b")))
    assert (r["red"], r["green"], r["s"], r["n"]) == ("#ff0000", "#00ff00", "tokyo-metro", 4) and r["h"] == 193485963 % 360 and r["t"].startswith("op")


def test_envelope_states(spark):
    ok = spark.range(1).select(tx.encode_envelope(F.lit('{"v":1,"b":[1,{"z":null,"a":2}]}')).alias("e")).first()["e"]
    again = spark.range(1).select(tx.encode_envelope(F.lit('{ "b":[1,{"a":2}], "v": 1}')).alias("e")).first()["e"]
    assert ok == again and "=" not in ok and "+" not in ok
    v2 = spark.range(1).select(tx.encode_envelope(F.lit('{"v":2}')).alias("e")).first()["e"]
    df = spark.createDataFrame([(x,) for x in (ok, "%%%", "AAAA", v2, None)], "p string").select(tx.decode_envelope("p").alias("d"))
    assert [r["d"]["status"] for r in df.collect()] == ["ok", "invalid-base64url", "inflate-failed", "unsupported-version", "invalid-base64url"]
    assert one(spark, p=tx.link_payload(F.lit("https://x.org/a?b=1&d=ab_-9")))["p"] == "ab_-9"


def test_ids(spark):
    r = one(spark, a=tx.gtfs_id("route", F.lit("n s"), F.lit("a/b(1)")), b=tx.is_route_id(F.lit("osm:relation:012")), c=tx.is_station_id(F.lit("osm:node:12")), d=tx.relation_id(F.lit("9007199254740993")), e=tx.decode_entities(F.lit("&amp;lt;&#65;&#x42;&lt;")))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == ("gtfs:n%20s:route:a%2Fb(1)", False, True, None, "&lt;AB<")
    with pytest.raises(Exception, match="empty part"):
        one(spark, a=tx.gtfs_id("stop", F.lit(""), F.lit("x")))
