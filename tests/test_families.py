"""All question families at once on a small grid, against plain Python."""

import math

import numpy as np

from waymark.operators import elimination, families


def m(lon1, lat1, lon2, lat2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371008.8 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def test_all_families(spark):
    rng = np.random.default_rng(0)
    pois = [(i, ("park", "zoo", "station-name-length")[i % 3], int(rng.integers(3, 6)), *map(float, rng.random(2) * 0.5 + [139.0, 35.0])) for i in range(45)]
    stops = [(i, ["a"] if i % 2 else ["b"], *map(float, rng.random(2) * 0.5 + [139.0, 35.0])) for i in range(8)]
    on = next(p for p in pois if p[1] == "zoo")
    q = [  # ord, type, answer, lon, lat, distance, lon2, lat2, category, selected, line
        (1, "radar", "positive", 139.25, 35.25, 30000.0, None, None, None, None, None), (2, "radar", "negative", 139.1, 35.1, 5000.0, None, None, None, None, None), (3, "radar", "unanswered", 139.1, 35.1, 1.0, None, None, None, None, None),
        (4, "thermometer", "colder", 139.2, 35.2, None, 139.45, 35.4, None, None, None), (5, "thermometer", "hotter", 139.2, 35.2, None, 139.2, 35.2001, None, None, None),
        (6, "matching", "negative", None, None, None, None, None, "park", 0, None), (7, "matching", "positive", None, None, None, None, None, "station-name-length", 2, None),
        (8, "tentacles", "negative", 139.4, 35.1, 6000.0, None, None, "park", None, None), (9, "measuring", "closer", 139.3, 35.3, None, None, None, "zoo", None, None), (10, "measuring", "further", on[3], on[4], None, None, None, "zoo", None, None),
        (11, "transit-line", "negative", None, None, None, None, None, None, None, "a"), (12, "transit-line", "negative", None, None, None, None, None, None, None, "b"),
    ]
    cells = elimination.cell_grid(spark, 139.0, 35.0, 139.5, 35.5, 14)
    questions = spark.createDataFrame(q, "ord int, type string, answer string, lon double, lat double, distance double, lon2 double, lat2 double, category string, selected int, line string")
    candidates = spark.createDataFrame(pois, "poi int, category string, name_length int, r_lon double, r_lat double")
    stations = spark.createDataFrame(stops, "station int, route_ids array<string>, r_lon double, r_lat double")
    tests = families.constraints(cells, questions, candidates, stations, 12000.0)
    got = {r["cell"]: r["eligible"] for r in elimination.eligible(cells, tests).collect()}

    near = lambda kind, x, y: min((p for p in pois if p[1] == kind), key=lambda p: ((x - p[3]) ** 2 + (y - p[4]) ** 2, p[0]))
    least = lambda kind, x, y: min(m(x, y, p[3], p[4]) for p in pois if p[1] == kind)
    d = least("zoo", 139.3, 35.3)
    k = math.cos(math.radians(35.3)) ** 2
    for r in cells.collect():
        x, y = r["lon"], r["lat"]
        want = min(m(x, y, s[2], s[3]) for s in stops) <= 12000 and m(x, y, 139.25, 35.25) <= 30000 and m(x, y, 139.1, 35.1) > 5000
        want = want and (x - 139.325) * k * 0.125 + (y - 35.3) * 0.1 <= 0 and near("park", x, y)[0] != 0 and near("station-name-length", x, y)[2] == pois[2][2]
        want = want and not (m(x, y, 139.4, 35.1) <= 6000 and any(m(p[3], p[4], 139.4, 35.1) <= 6000 for p in pois if p[1] == "park")) and least("zoo", x, y) <= d
        want = want and min(m(x, y, s[2], s[3]) for s in stops if "a" in s[1]) > 12000
        assert got[r["cell"]] == want, (r, want)
    assert 0 < sum(got.values()) < len(got)
