"""Lines built end to end: masters, resolution, overrides, repairs, tracks, attached stations, reasons."""

import math

import pytest

from waymark.operators import line_builder


def at(km_east, m_north=0.0):
    return 139.0 + km_east * 1000 / (111320 * math.cos(math.radians(35.0))), 35.0 + m_north / 111320


@pytest.fixture(scope="module")
def lines(spark):
    stations = [(f"n{i}", f"name{i}", "station" if i % 2 else "halt", *at(i * 8)) for i in range(12)] + [("far", "far", "station", *at(900)), ("blank", None, "station", *at(16, 5))]
    routes = [("r1", {"name": "One", "route": "train"}), ("r2", {"route": "train", "operator": "Op"}), ("r3", {"ref": "T", "route": "railway"}), ("r4", {"route": "train"}), ("r5", {"route": "train"}), ("r6", {"route": "train"}), ("r7", {"route": "train"}), ("r8", {"route": "subway"})]
    masters = [("m1", {"name": "Master", "network": "Net"}, ["r1", "r2"]), ("m2", {"name": "Empty"}, ["r99"])]
    node = lambda r, i, ref, role="stop", name=None, place=(None, None): (r, i, "node", ref, role, name, *place)
    members = [node("r1", i, f"n{k}") for i, k in enumerate([0, 1, 1, 2, 3])] + [node("r1", 9, "n7", "platform")]
    members += [node("r2", 0, "x", place=at(16, 100)), node("r2", 1, "y", name="name4"), node("r2", 2, "z", name="nobody"), node("r2", 3, "w", "stop_exit_only", "name5", at(700))]
    members += [("r3", i, "way", w, "", None, None, None) for i, w in enumerate(["a", "b", "a"])]
    members += [node("r4", i, f"n{k}") for i, k in enumerate([0, 1, 2, 7, 3, 4])]  # n7 belongs at the end
    members += [node("r5", 0, "n3"), node("r5", 1, "n3")]
    members += [node("r6", i, f"n{k}") for i, k in enumerate([2, 0, 1, 3])]
    members += [node("r8", 0, "n1"), node("r8", 1, "n2"), ("r8", 5, "way", "b", "", None, None, None)]
    ways = [("a", [at(0), at(8), at(16)]), ("b", [at(16), at(24, 50)]), ("c", [at(500), at(501)])]
    point = lambda xy: {"x": xy[0], "y": xy[1]}
    frame = spark.createDataFrame
    out = line_builder.build_lines(
        frame(routes, "relation string, tags map<string,string>"), frame(masters, "relation string, tags map<string,string>, members array<string>"),
        frame(members, "relation string, seq int, type string, ref string, role string, name_key string, lon double, lat double"),
        frame(stations, "station string, name_key string, kind string, s_lon double, s_lat double"), frame([(w, [point(p) for p in ps]) for w, ps in ways], "way string, line array<struct<x:double,y:double>>"),
        frame([("r6", ["n0", "n1", "n9"], False)], "variant string, stop_order array<string>, quiet boolean"),
    )
    return {r["line"]: r for r in out.collect()}


def test_every_primary_relation_has_a_row_and_a_reason(lines):
    assert {k: r["reason"] for k, r in lines.items()} == {"m1": None, "m2": "no variants", "r3": None, "r4": None, "r5": "too few stations", "r6": None, "r7": "too few stations", "r8": None}
    assert [lines[k]["mastered"] for k in ("m1", "m2", "r3")] == [True, True, False]


def test_members_resolve_by_id_place_and_name(lines):
    m = lines["m1"]
    assert m["stations"] == ["n0", "n1", "n2", "n3", "n4"] and m["unresolved"] == 2 and m["name"] == "Master" and m["operator"] == "Op"
    assert m["source"] == "stops" and [len(g) for g in m["geometry"]] == [4, 2] and (m["ambiguous"], m["weak"]) == (0, 0)


def test_ways_are_chained_once_and_stations_attached_to_tracks_only(lines):
    t = lines["r3"]
    assert t["name"] == "T" and t["source"] == "ways" and [len(g) for g in t["geometry"]] == [3] and sorted(t["stations"][2:4]) == ["blank", "n2"] and t["stations"][:2] + t["stations"][4:] == ["n0", "n1", "n3"]
    assert lines["r8"]["source"] == "ways" and lines["r8"]["stations"] == ["n1", "n2"]


def test_orders_are_overridden_or_repaired(lines):
    assert lines["r6"]["stations"] == ["n0", "n1", "n2", "n3"] and lines["r6"]["repaired"] == 0
    assert lines["r4"]["jumps"] > 0 and lines["r4"]["repaired"] == 1 and lines["r4"]["stations"] == ["n0", "n1", "n2", "n3", "n4", "n7"]
    assert lines["m1"]["jumps"] == 0


def test_ambiguous_and_weak_places(spark):
    s = spark.createDataFrame([("a", "a", "station", *at(0, 250)), ("b", "b", "station", *at(0, -255)), ("c", "c", "halt", *at(50, 10))], "station string, name_key string, kind string, s_lon double, s_lat double")
    m = spark.createDataFrame([("v", 0, "p", None, *at(0)), ("v", 1, "q", "a", *at(50)), ("v", 2, "a", None, None, None), ("v", 3, "q", "a", None, None), ("v", 4, "q", None, None, None)], "variant string, seq int, ref string, name_key string, lon double, lat double")
    got = [tuple(r)[1:] for r in line_builder.resolve_members(m, s).orderBy("seq").collect()]
    assert got == [(0, "a", "place", True, True), (1, "c", "place", False, False), (2, "a", "id", False, False), (3, "a", "name", False, False), (4, None, None, False, False)]


def test_no_relations(spark):
    frame = spark.createDataFrame
    out = line_builder.build_lines(
        frame([], "relation string, tags map<string,string>"), frame([], "relation string, tags map<string,string>, members array<string>"),
        frame([], "relation string, seq int, type string, ref string, role string, name_key string, lon double, lat double"), frame([], "station string, name_key string, kind string, s_lon double, s_lat double"),
    )
    assert out.count() == 0
