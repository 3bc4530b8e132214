"""Queries against their SQL where suppliers stand in equal places, as beyond 10,000 of them."""

import duckdb
import pytest

from waymark.plans.catalogue import QUERIES, SQL


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("places")
    c = duckdb.connect()
    keys = "SELECT unnest(range(60)) + far AS k FROM (VALUES (0), (10000), (20000)) t(far)"
    c.execute(f"copy (SELECT k AS s_suppkey, 's' || k AS s_name, (k % 25)::INT AS s_nationkey FROM ({keys})) to '{d}/supplier.parquet'")
    c.execute(f"copy (SELECT o::BIGINT AS o_orderkey, o % 40 AS o_custkey FROM range(300) t(o)) to '{d}/orders.parquet'")
    c.execute(f"copy (SELECT o::BIGINT AS l_orderkey, n::INT AS l_linenumber, (o * 7 + n * 13) % 60 + (o + n) % 3 * 10000 AS l_suppkey FROM range(300) t(o), range(1, 6) u(n)) to '{d}/lineitem.parquet'")
    return str(d)


@pytest.mark.parametrize("name", ["built_lines", "line_quality"])
def test_equal_places(spark, folder, name):
    con = duckdb.connect()
    for t in ("supplier", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == sorted(con.execute(f"select {', '.join(df.columns)} from ({SQL[name]})").fetchall(), key=repr)
