"""Junctions, components and lines that are settled in one pass, against versions that decide one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_strands import either, frame, joined, plain_junctions, rows
from waymark.operators import graph, strands


def grid(rng, side):
    ends = [((i, j), (i + di, j + dj)) for i in range(side) for j in range(side) for di, dj in ((1, 0), (0, 1), (1, 1)) if rng.random() < 0.7]
    keys = rng.sample(range(10_000), len(ends))
    return {k: [tuple(map(float, p)) for p in (e if rng.random() < 0.5 else e[::-1])] for k, e in zip(keys, ends, strict=True)}


@pytest.mark.parametrize("crowd", [64, 4])
def test_small_junctions_take_no_rounds(spark, monkeypatch, crowd):
    lines = grid(random.Random(5), 9)
    asked, plain = [], strands._straightest
    monkeypatch.setattr(strands, "_straightest", lambda *a: (asked.append(1), plain(*a))[1])
    monkeypatch.setattr(strands.junction_links, "__defaults__", (*strands.junction_links.__defaults__[:-1], crowd))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # lines over several batches
    try:
        got = rows(strands.stitch_segments(frame(spark, lines)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(a, b, either(c)) for a, b, c in got] == joined(lines, plain_junctions(lines), False)
    assert bool(asked) == (crowd == 4) and max(b for _, b, _ in got) > 5


@pytest.mark.parametrize("mixed", [False, True])
def test_a_long_line_takes_as_many_steps_as_a_short_one(spark, monkeypatch, mixed):
    saves, plain = [], graph.save
    monkeypatch.setattr(graph, "save", lambda df: (saves.append(1), plain(df))[1])
    monkeypatch.setattr(graph._pieces, "__defaults__", (500,))
    name = (lambda c: c * 7919 % 20_011) if mixed else (lambda c: c)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        edges = spark.range(20_010).select(name(F.col("id")).alias("a"), name(F.col("id") + 1).alias("b"))
        got = graph.connected_components(spark.range(20_012).select(F.col("id").alias("node")), edges)
        assert {r["component"]: r["n"] for r in got.groupBy("component").agg(F.count("*").alias("n")).collect()} == {0: 20_011, 20_011: 1}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert mixed or len(saves) <= 15
