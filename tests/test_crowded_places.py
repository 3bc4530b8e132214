"""Searches whose work must not grow with the rows that stand in one place or far off."""

from pyspark.sql import functions as F

from waymark.operators import search, spatial_join, transit
from waymark.operators.sequences import metres


def _met(monkeypatch, module):
    seen, plain = [], spatial_join.within_distance

    def counted(*args, **how):
        out = plain(*args, **how)
        seen.append(out.count())
        return out

    monkeypatch.setattr(module, "within_distance", counted)
    return seen


def test_nearest_meets_few_pairs_in_a_crowd(spark, monkeypatch):
    seen = _met(monkeypatch, spatial_join)
    left = spark.createDataFrame([(k, 139.0 + k * 0.01, 35.0) for k in range(20)], "k int, lon double, lat double")
    right = spark.createDataFrame([(p, 139.0 + p % 40 * 0.01, 35.0) for p in range(4000)], "p int, r_lon double, r_lat double")
    got = {(r["k"], r["rank"]): r["p"] for r in spatial_join.nearest(left, right, 3, 8000.0, ["k"], ["p"]).collect()}
    assert got == {(k, n + 1): k + 40 * n for k in range(20) for n in range(3)}
    assert sum(seen) <= 20 * 3


def test_stops_in_one_place_look_once(spark, monkeypatch):
    seen = _met(monkeypatch, transit)
    stops = spark.createDataFrame([(k, None, None, 139.0 + k % 3 * 0.01, 35.0) for k in range(300)], "stop int, ref int, name_key string, lon double, lat double")
    stations = spark.createDataFrame([(s, "n", ("halt", "station")[s % 2], 139.0001 + s % 3 * 0.01, 35.0) for s in range(300)], "station int, name_key string, kind string, r_lon double, r_lat double")
    got = {r["stop"]: (r["station"], r["how"]) for r in transit.resolve_stops(stops, stations, 4000.0).collect()}
    assert got == {k: ((3, 1, 5)[k % 3], "place") for k in range(300)}
    assert sum(seen) <= 30


def test_near_the_pole_longitudes_cost_nothing(spark):
    rows = [(k, 18.0 * k, 89.9999999 if k % 2 else 150.0) for k in range(20)]
    left = spark.createDataFrame(rows, "a int, lon double, lat double")
    right = spark.createDataFrame(rows, "b int, r_lon double, r_lat double")
    got = {(r["a"], r["b"]) for r in spatial_join.within_distance(left, right, 1.0).collect()}
    assert got == {(a, b) for a in range(20) for b in range(20) if a == b or (a % 2 and b % 2)}


def test_nearest_anywhere_meets_places_once(spark, monkeypatch):
    seen = _met(monkeypatch, spatial_join)
    left = spark.createDataFrame([(k, 139.0 + k % 20 * 0.01, 35.0) for k in range(200)] + [(900, None, 35.0)], "k int, lon double, lat double")
    right = spark.createDataFrame([(p, 139.001 + p % 40 * 0.01, 35.0) for p in range(4000)], "p int, r_lon double, r_lat double")
    got = {r["k"]: r["best"] for r in spatial_join.nearest_anywhere(left, right, ["k"], F.col("p"), tie=F.col("p")).collect()}
    assert got == {k: k % 20 for k in range(200)} | {900: None}
    assert sum(seen) <= 20 * 5


def test_requests_in_one_place_meet_few_circles(spark, monkeypatch):
    seen, plain = [], search.save
    monkeypatch.setattr(search, "save", lambda df: (seen.append(df.count()), plain(df))[1])
    circles = [(c, "c", 139.0 + c % 3 * 0.001, 35.0, 300.0 + c * 7 % 2000) for c in range(600)]
    asks = [(q, "c", 139.0005, 35.0, 100.0 + q) for q in range(1500)]
    cached = spark.createDataFrame([(c, c, k, x, y, r) for c, k, x, y, r in circles], "cached int, fetched_at int, category string, c_lon double, c_lat double, c_r double")
    requests = spark.createDataFrame(asks, "request int, category string, lon double, lat double, r double")
    got = {r["request"]: r["cached"] for r in search.freshest_covering(requests, cached).collect()}
    far = {x: float(metres(x, 35.0, 139.0005, 35.0)) * 6371008.8 / 6371000 for x in {c[2] for c in circles}}
    want = {q: max((c for c, _, x, _, cr in circles if far[x] + r <= cr), default=None) for q, _, _, _, r in asks}
    assert got == {q: c for q, c in want.items() if c is not None} and len(got) > 1000
    assert sum(seen) < 100  # circles left at their centres, and at the place of the requests


def test_equal_areas_choose_a_pack_once(spark, monkeypatch):
    seen, plain = [], search.save
    monkeypatch.setattr(search, "save", lambda df: (seen.append(df.count()), plain(df))[1])
    box = lambda x, y, r: {"w": x - r, "s": y - r, "e": x + r, "n": y + r}
    kind = "struct<w:double,s:double,e:double,n:double>"
    packs = spark.createDataFrame([(1, False, box(0.5, 0.5, 0.4)), (2, True, box(0.9, 0.5, 0.3)), (3, True, box(0.5, 0.5, 0.3)), (4, True, box(0.5, 0.5, 0.2))], f"pack int, installed boolean, box {kind}")
    requests = spark.createDataFrame([(k, box((0.5, 0.95, 0.12, 3.0)[k % 4], 0.5, 0.02)) for k in range(400)], f"request int, area {kind}")
    got = {r["request"]: (r["pack"], r["contains"]) for r in search.best_pack(requests, packs).collect()}
    assert got == {k: ((4, True), (2, True), (1, True))[k % 4] for k in range(400) if k % 4 < 3}
    assert seen == [4, 3]
