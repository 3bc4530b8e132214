"""What the deduplicating stages keep where ids are null or repeat: rows are decided one by one."""

import pytest

from waymark.llm import exact_dedup, simhash

A, B, C, D = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
ROWS = [(1, A, 0), (5, A, 1), (5, B, 2), (None, A, 3), (None, C, 4), (None, C, 5), (7, D, 6), (7, D, 7), (7, D.replace(" ", "  "), 8), (None, None, 9), (9, "", 10)]


def first(df):
    return exact_dedup.keep_first(df, repeats=False)


@pytest.mark.parametrize("keep", [first, simhash.keep_one])
def test_one_row_of_each_group_stays(spark, keep):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, n int")
    kept = keep(df)
    assert kept.columns == df.columns
    got = sorted((r["n"], r["doc_id"]) for r in kept.collect())
    assert [x for x in got if x[0] not in (4, 5, 6, 7, 8)] == [(0, 1), (2, 5), (10, 9)]
    assert len(got) == 5 and len({n for n, _ in got} & {4, 5}) == 1 and len({n for n, _ in got} & {6, 7, 8}) == 1


def test_a_large_group_of_repeated_rows_leaves_one(spark):
    df = spark.createDataFrame([(i % 2 or None, A) for i in range(3000)], "doc_id long, text string")
    assert [r["doc_id"] for r in first(df).collect()] == [1]
    assert [r["doc_id"] for r in simhash.keep_one(df).collect()] == [1]


def test_repeats_stay_where_asked_for(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, n int")
    assert sorted(r["n"] for r in exact_dedup.keep_first(df).collect()) == [0, 2, 4, 5, 6, 7, 8, 10]
