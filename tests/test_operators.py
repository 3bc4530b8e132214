"""Joins, elimination, ordered algorithms, sources and state on small literals, edge rows included."""

import gzip
import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import elimination, etl, measuring, overlay, search, sequences, spatial_join, state, transit
from waymark.operators.graph import connected_components
from waymark.sources import readers
from waymark.streaming import events as streams


def line(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


LINE = "array<struct<x:double,y:double>>"


def test_within_distance_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    a, b = rng.random((120, 2)) * [0.4, 0.4] + [139.9, 60.0], rng.random((150, 2)) * [0.4, 0.4] + [139.9, 60.0]
    left = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)], "a int, lon double, lat double")
    right = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(b)], "b int, r_lon double, r_lat double")
    got = {(r["a"], r["b"]) for r in spatial_join.within_distance(left, right, 3000.0).collect()}
    d = sequences.metres(a[:, None, 0], a[:, None, 1], b[None, :, 0], b[None, :, 1]) * (geo.EARTH_M / sequences.EARTH_M)
    assert got == set(zip(*map(list, np.nonzero(d <= 3000.0)))) and len(got) > 50


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(40)], "node long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 35), (35, 30)], "a long, b long")
    got = dict(map(tuple, connected_components(nodes, edges).collect()))
    assert all(got[i] == 0 for i in range(21)) and got[35] == 30 and got[39] == 39


def test_nearest_anywhere_of_nothing(spark):
    s = spark.createDataFrame([(1, 139.0, 35.0)], "station int, lon double, lat double")
    p = spark.createDataFrame([], "poi int, r_lon double, r_lat double")
    r = spatial_join.nearest_anywhere(s, p, ["station"], F.col("poi")).first()
    assert r["best"] is None and r["m"] is None


def test_points_along_a_line(spark):
    lines = spark.createDataFrame([(1, line((139.0, 35.0), (139.1, 35.0), (139.1, 35.1))), (2, line((150.0, 35.0)))], f"line_id int, line {LINE}")
    pts = spark.createDataFrame([(1, 139.1, 35.05), (2, 139.05, 35.001), (3, 139.05, 35.2), (4, None, 35.0)], "poi int, lon double, lat double")
    got = [(r["poi"], r["seg"], r["place"]) for r in spatial_join.points_along_lines(pts, lines, 500.0, "poi", "line_id").orderBy("place").collect()]
    assert got == [(2, 0, 1), (1, 1, 2)]


def test_nearest_however_far(spark):
    left = spark.createDataFrame([(1, 139.0, 35.0), (2, 139.0, 36.0), (3, -60.0, -30.0), (4, None, 35.0)], "station int, lon double, lat double")
    right = spark.createDataFrame([(5, 139.0, 35.01), (6, 139.0, 37.0), (7, None, 35.0)], "poi int, r_lon double, r_lat double")
    got = {r["station"]: r["best"] for r in spatial_join.nearest_anywhere(left, right, ["station"], F.col("poi"), tie=F.col("poi")).collect()}
    assert got == {1: 5, 2: 5, 3: 6, 4: None}


# --- elimination


def grid(spark, steps=20):
    return elimination.cell_grid(spark, 139.0, 35.0, 140.0, 36.0, steps)


def test_no_constraint_leaves_everything(spark):
    cells = grid(spark)
    none = spark.createDataFrame([], "cell long, constraint string, required boolean, hit boolean")
    assert elimination.eligible(cells, none).filter("eligible").count() == 400


def test_separate_and_whole_constraints(spark):
    cells = spark.createDataFrame([(0,), (1,), (2,)], "cell long")
    rows = [(0, "zone", True, True), (0, "zone", True, False), (1, "zone", True, False), (2, "zone", True, True), (2, "miss", False, True), (0, "miss", False, False)]
    got = {r["cell"]: r["eligible"] for r in elimination.eligible(cells, spark.createDataFrame(rows, "cell long, constraint string, required boolean, hit boolean")).collect()}
    assert got == {0: True, 1: False, 2: False}


def test_contributions_telescope(spark):
    cells = grid(spark)
    tests = cells.select("cell", F.lit(1).alias("ord"), (F.col("lon") < 139.5).alias("holds")).union(cells.select("cell", F.lit(2), F.lit(None).cast("boolean"))).union(cells.select("cell", F.lit(3), F.col("lat") < 35.5))
    out = elimination.contributions(tests, cells, F.lit(True)).orderBy("ord").collect()
    assert [r["percent"] for r in out] == [50, 0, 25] and out[0]["after_m2"] == out[1]["before_m2"] == out[1]["after_m2"]
    r = spark.range(1).select(elimination.zone_percent(F.lit(0.0), F.lit(0.0)).alias("a"), elimination.zone_percent(F.lit(1.0), F.lit(2.0)).alias("b")).first()
    assert (r["a"], r["b"]) == (0, 50)


def test_short_thermometer_constrains_nothing(spark):
    df = spark.createDataFrame([(139.5, 35.5, 139.0, 35.0, 139.0, 35.0), (139.5, 35.5, 139.0, 35.0, 139.6, 35.6)], "lon double, lat double, a double, b double, c double, d double")
    got = [r[0] for r in df.select(elimination.thermometer_holds("lon", "lat", "a", "b", "c", "d", F.lit("hotter"))).collect()]
    assert got == [None, True]


def test_search_ladder():
    assert search.radius_ladder(100.0)[:3] == [1200.0, 2400.0, 4800.0] and search.radius_ladder(1000.0)[0] == 2000.0 and search.radius_ladder(1.0)[-1] == 200000.0


# --- ordered algorithms


def test_repair_moves_an_outlier_back():
    xy = np.array([(139.0 + 0.01 * k, 35.0) for k in range(12)])
    order = [0, 1, 2, 11, 3, 4, 5, 6, 7, 8, 9, 10]
    far = np.array([(139.0 + 0.05 * k, 35.0) for k in range(12)])
    assert (far[order][sequences.repair_order(far[order])] == far).all()
    assert (sequences.repair_order(xy) == np.arange(12)).all()
    wild = np.array([(139.0, 35.0), (145.0, 35.0), (139.1, 35.0), (146.0, 40.0), (139.2, 35.0), (150.0, 30.0), (139.3, 35.0)])
    assert (sequences.repair_order(wild) == np.arange(7)).all()


def test_chaining_ways(spark):
    a, b, c, d = (0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 0.0)
    assert sequences.chain([[a, b], [c, b], [d, c], [(9.0, 9.0)]]) == [[a, b, c, d]]
    df = spark.createDataFrame([(1, 0, line(a, b)), (1, 1, line(d, c)), (2, 0, line(a, b)), (2, 1, line(b, c))], f"relation int, ord int, line {LINE}")
    assert sorted((r["relation"], len(r["line"])) for r in sequences.stitch_ways(df).collect()) == [(1, 2), (1, 2), (2, 3)]


def test_gaps_and_parallels():
    a, b = np.array([(139.0, 35.0), (139.01, 35.0)]), np.array([(139.015, 35.0), (139.03, 35.0)])
    assert len(sequences.bridge_gaps([a, b])) == 1 and len(sequences.bridge_gaps([a, b + [0, 0.01]])) == 2
    assert sequences.parallel_duplicates([a, a + [0, 0.0001], a[::-1] + [0, 0.00005], a + [0, 0.01]]) == [0, 3]


def test_station_rounds(spark):
    cols = "id string, name string, name_en string, normalised string, wikidata string, operator string, tags map<string,string>, lon double, lat double, ord int"
    rows = [
        ("n1", "A", None, "a", "Q1", None, {}, 139.0, 35.0, 0), ("n1", "A2", "A", "a", "Q1", "op", {}, 139.0, 35.0, 1), ("n2", "A", "A", "a", "Q1", "op", {"railway": "station"}, 139.5, 35.0, 2),
        ("n3", "B", None, "b", None, None, {}, 139.0, 35.0, 3), ("n4", "B", None, "b", None, None, {}, 139.001, 35.0, 4), ("n5", "B", None, "b", None, None, {}, 139.01, 35.0, 5), ("n6", None, None, "", None, None, {}, 139.0, 35.0, 6),
    ]
    got = {r["id"]: r["ord"] for r in sequences.dedupe_stations(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"n2": 0, "n3": 3, "n5": 5, "n6": 6}


def test_merging_stations_takes_timetables_first(spark):
    rows = [("k", "osm", 0, "o", "Osm", "En", 1.0, 1.0, ["r2"], ["#b"]), ("k", "gtfs", 1, "g", "Gtfs", "", 2.0, 2.0, ["r1", "r2"], ["#a", "#b"])]
    df = spark.createDataFrame(rows, "merge_key string, source_kind string, ord int, id string, name string, name_en string, lon double, lat double, route_ids array<string>, colours array<string>")
    r = transit.merge_stations(df).first()
    assert (r["name"], r["name_en"], r["source_ids"], r["route_ids"], r["colours"]) == ("Gtfs", "En", ["g", "o"], ["r1", "r2"], ["#a", "#b"])


def test_overlay_of_squares(spark):
    sq = lambda w, s, e, n: [[line((w, s), (e, s), (e, n), (w, n), (w, s))]]
    df = spark.createDataFrame([(1, "a", sq(139.0, 35.0, 139.2, 35.2)), (1, "b", sq(139.1, 35.0, 139.3, 35.2))], f"k int, side string, multi array<array<{LINE}>>")
    r = overlay.rasterise(df, ["k", "side"], 0.01)
    out = overlay.overlay_areas(r.filter("side = 'a'"), r.filter("side = 'b'"), "k", 0.01).first()
    assert abs(out["union_m2"] / out["both_m2"] - 3) < 1e-6 and abs(out["sym_diff"] - 2 / 3) < 1e-6
    assert overlay.dissolve(r, 0.01).agg(F.sum("cells")).first()[0] == 600


def test_continuity(spark):
    df = spark.createDataFrame([(1, line((139.0, 35.0), (139.05, 35.0))), (2, line((139.0501, 35.0), (139.1, 35.0))), (3, line((139.5, 35.0), (139.6, 35.0))), (4, line((139.0, 35.0), (139.0001, 35.0)))], f"line_id long, line {LINE}")
    r = measuring.continuity(df).first()
    assert (r["components"], r["lines"]) == (2, 3)


# --- sources


def test_elements(spark):
    e = [
        {"type": "node", "id": 1, "lat": 35.0, "lon": 139.0, "tags": {"name": " A ", "iata": " XYZ "}}, {"type": "way", "id": 2, "center": {"lat": 35.0, "lon": 139.0}, "tags": {"name": "B"}},
        {"type": "node", "id": 3, "lat": 35.0, "lon": 139.0, "tags": {}}, {"type": "node", "id": 4, "tags": {"name": "C"}}, {"type": "area", "id": 5, "lat": 1.0, "lon": 1.0, "tags": {"name": "D"}}, {"type": "node", "id": 6, "lat": 35.0, "lon": 139.0, "tags": {"name": "  "}},
    ]
    df = spark.createDataFrame([(json.dumps({"elements": e}),), ('{"elements":[]}',), ("not json",), (None,)], "json string")
    got = [(r["osm_id"], r["name"], r["iata"]) for r in readers.parse_elements(df, category="commercial-airport").orderBy("osm_id").collect()]
    assert got == [(1, "A", "XYZ"), (2, "B", None)]


def test_bundles_and_columns(spark):
    c = lambda n, **k: {"count": n, "lon": [1.0], "lat": [2.0], "name": ["x"], "osmId": [5], **k}
    docs = [{"schemaVersion": 1, "region": "r", "categories": {"park": c(1), "zoo": c(2)}}, {"schemaVersion": 2, "region": "s", "categories": {"park": c(1)}}]
    b = readers.read_bundles(spark.createDataFrame([(json.dumps(d),) for d in docs], "json string"))
    assert b.count() == 2 and [tuple(r) for r in etl.from_columnar(b).collect()] == [("park", 0, 5, 1.0, 2.0, "x")]


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.geojsonl").write_text('\x1e{"id":"n1","properties":{"k":"v"},"geometry":{"type":"Point","coordinates":[1,2]}}\nbroken\n')
    assert [(r["id"], r["kind"], r["tags"]) for r in readers.read_geojson_lines(spark, str(tmp_path / "a.geojsonl")).collect()] == [("n1", "Point", {"k": "v"})]
    (tmp_path / "feed-stops.txt").write_text('stop_name,stop_id,stop_lat,stop_lon\r\n"Say ""hi"", ok",s1,35.0,139.0\r\n,,,\r\n')
    rows = readers.read_gtfs(spark, str(tmp_path), "stops").collect()
    assert [(r["stop_id"], r["stop_name"]) for r in rows] == [("s1", 'Say "hi", ok')]
    (tmp_path / "m.osm").write_text('<osm><node id="1" lat="35" lon="139"><tag k="name" v="A"/></node><way id="7"><nd ref="1"/><nd ref="2"/><tag k="usage" v="tourism"/></way><relation id="9"><member type="way" ref="7" role=""/></relation></osm>')
    n, w, r = readers.read_osm_xml(spark, str(tmp_path / "m.osm"))
    assert n.first()["tags"] == {"name": "A"} and w.first()["nodes"] == [1, 2] and r.first()["members"][0]["ref"] == 7
    assert readers.without_members(n, w.withColumnRenamed("nodes", "refs"), ["tourism"]).count() == 0


def test_installing_artifacts(spark):
    body = json.dumps({"schemaVersion": 2, "x": 1}).encode()
    raw = gzip.compress(body)
    good = (len(raw), hashlib.md5(raw).hexdigest(), hashlib.sha256(body).hexdigest(), 2)
    files = [(n, raw) for n in "abcde"] + [("f", gzip.compress(b"0" * 10_000))]
    bomb = files[-1][1]
    manifest = [("a", *good), ("b", 1, *good[1:]), ("c", good[0], "x", *good[2:]), ("d", *good[:2], "x", 2), ("e", *good[:3], 1), ("f", len(bomb), hashlib.md5(bomb).hexdigest(), "x", 1)]
    got = dict(readers.install(spark.createDataFrame(files, "file string, content binary"), spark.createDataFrame(manifest, "file string, bytes long, md5 string, sha256 string, schema_version int")).select("file", "status").collect())
    assert got == {"a": "ok", "b": "size", "c": "md5", "d": "sha256", "e": "schema-version", "f": "inflate-limit"}


# --- state and streams


def test_questions_and_state(spark):
    q = [{"id": "1", "type": "radius", "distance": 5.0, "lon": 1.0, "lat": 2.0}, {"id": "", "type": "radar"}, {"id": "2", "type": "matching", "answer": "negative"}, {"id": "3", "type": "nope"}, {"id": "4", "type": "radar", "distance": -1.0, "lon": 0.0, "lat": 0.0}]
    df = spark.createDataFrame([(1, json.dumps(q)), (2, "{}"), (3, None)], "owner int, json string")
    assert [(r["owner"], r["ord"], r["type"], r["answer"]) for r in state.parse_questions(df).collect()] == [(1, 0, "radar", "unanswered"), (1, 2, "matching", "negative")]
    rows = [(1, '{"version":1,"units":"furlong","playArea":{"osmId":7}}'), (2, '{"version":2}'), (3, "junk"), (4, None)]
    got = {r["k"]: (r["version"], r["play_area"], r["units"], r["questions"]) for r in state.migrate_state(spark.createDataFrame(rows, "k int, json string")).collect()}
    assert got == {1: (1, 7, "metric", "[]"), 2: (None,) * 4, 3: (None,) * 4, 4: (None,) * 4}
    with pytest.raises(Exception, match="not positive"):
        state.select_poi(spark.range(1), F.lit(0)).collect()
    r = spark.range(1).select(*state.reconcile_line(F.lit("a"), F.lit("positive"), F.array(F.lit("b")))).first()
    assert tuple(r) == ("b", "positive")


def test_streams_see_late_rows(spark, tmp_path):
    at = tmp_path / "events.parquet"
    for k, days in enumerate(([1, 2], [20], [1, 20])):
        pd.DataFrame({"event_id": [10 * k + i for i in range(len(days))], "ts": pd.to_datetime([f"2024-01-{d:02}" for d in days]).astype("datetime64[us]"), "user_id": 1, "event_type": "x", "value": 1.0}).to_parquet(at.parent / f"p{k}.parquet")
    at.mkdir()
    for k in range(3):
        (at.parent / f"p{k}.parquet").rename(at / f"p{k}.parquet")
    s = streams.read_events(spark, str(at))
    assert streams.run_to_end(streams.latest_requests(s), "update", ["user_id"]).first()["n"] == 5
    assert sum(r["n"] for r in streams.run_to_end(streams.windowed_counts(streams.read_events(spark, str(at))), "update", ["start", "event_type"]).collect()) == 5
