"""Lines in rows that run up to a pole and past it, where gaps shrink below a metre and cosines turn negative."""

import duckdb

from waymark.plans.catalogue import QUERIES, SQL


def test_rows_are_joined_at_and_past_a_pole_as_the_sql_joins_them(spark, tmp_path):
    con = duckdb.connect()
    con.execute("create table supplier as select k as s_suppkey from (select unnest(range(40)) union all select unnest(range(27400, 27600)) union all select unnest(range(59960, 60000))) t(k)")
    con.execute(f"copy supplier to '{tmp_path}/supplier.parquet'")
    df = QUERIES["bridged_lines"](spark, str(tmp_path))
    plain = lambda rows: sorted(tuple(v + 0 for v in r) for r in rows)
    got = plain(df.collect())
    assert got == plain(con.execute(f"select {', '.join(df.columns)} from ({SQL['bridged_lines']})").fetchall())
    assert (27400, 10, 20) in {r[:3] for r in got} and (27500, 10, 20) in {r[:3] for r in got} and (27590, 10, 20) in {r[:3] for r in got}
