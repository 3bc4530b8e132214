"""Jobs whose work must follow the different places and shapes, not the rows; on tables where keys repeat their places."""

import duckdb
import pytest

from waymark.plans.catalogue import QUERIES, SQL

KEYS = "SELECT unnest(range({n})) + far AS k FROM (VALUES (0), (10000), (20000)) t(far)"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("equal")
    c = duckdb.connect()
    c.execute(f"copy (SELECT k AS s_suppkey, 's' || k AS s_name, (k % 25)::INT AS s_nationkey FROM ({KEYS.format(n=30)})) to '{d}/supplier.parquet'")
    c.execute(f"copy (SELECT k AS c_custkey, 'c' || k AS c_name, CASE WHEN k % 3 = 0 THEN 'BUILDING' ELSE 'OTHER' END AS c_mktsegment FROM ({KEYS.format(n=200)})) to '{d}/customer.parquet'")
    return str(d)


def check(spark, folder, name):
    con = duckdb.connect()
    for t in ("supplier", "customer"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    plain = lambda rows: sorted((tuple(round(v, 4) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    got = plain(df.collect())
    assert got == plain(con.execute(f"select {', '.join(df.columns)} from ({SQL[name]})").fetchall())
    return got


def test_pairs_of_lines_and_points_by_class(spark, folder):
    got = check(spark, folder, "pois_along_lines")
    pairs = [r for r in got if r[0] == "pair"]
    assert pairs and all(r[1] < 10000 and r[2] < 10000 for r in pairs)  # one line and one point of each class
    assert sum(r[0] == "line" for r in got) == 90 and sum(r[0] == "poi" for r in got) == 600


def _runs(monkeypatch):
    """Counts the shapes that arrangements are made of."""
    from waymark.operators import arrangement

    seen, plain = [], arrangement.arranged

    def counted(edges, key, cell=None):
        seen.append(edges.select(*key).distinct().count())
        return plain(edges, key, cell)

    monkeypatch.setattr(arrangement, "arranged", counted)
    return seen


def test_equal_lines_are_buffered_once(spark, folder, monkeypatch):
    seen = _runs(monkeypatch)
    assert len(check(spark, folder, "buffered_segments")) == 597
    assert seen == [199]


def test_equal_squares_are_dilated_once(spark, folder, monkeypatch):
    seen = _runs(monkeypatch)
    assert len(check(spark, folder, "dilated_squares")) == 90
    assert seen == [30]


def test_cells_of_equal_questions_are_cut_once(spark, folder, monkeypatch):
    seen = _runs(monkeypatch)
    assert len(check(spark, folder, "concave_cells")) > 300
    assert seen == [100]


def test_stations_of_one_place_are_paired_once(spark, folder):
    got = check(spark, folder, "station_pairs")
    assert sum(b >= 10000 for _, b, _ in got) == 60 and all(m == 0 for _, b, m in got if b >= 10000)


def test_every_line_meets_every_point_near_it(spark, folder):
    got = check(spark, folder, "pois_along_lines")
    near = {r[1:3]: r[4:] for r in got if r[0] in ("pair", "copy")}
    assert len(near) == sum(r[0] in ("pair", "copy") for r in got) == 9 * sum(r[0] == "pair" for r in got)  # three lines and three points of each class
    assert all(v == near[line % 10000, poi % 10000] for (line, poi), v in near.items())
