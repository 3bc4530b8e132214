"""Benchmark overlaps of very long items and texts, and of words that repeat without end."""

import contextlib
import io
import time

import numpy as np

from tests.llm.test_corpus import overlap_truth
from waymark.llm import decontaminate


def found(spark, rows, items):
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id long, size string")  # names that the operator uses itself
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id long")
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in decontaminate.decontaminate(df, bench).collect()}


def test_long_items(spark):
    words = np.random.default_rng(4).choice([f"w{i}" for i in range(5000)], 20_000).tolist()
    items = [(1, " ".join(words), 0), (2, "b " * 20_000, 0), (None, " ".join(words[:50]), 0)]
    docs = [(1, "x " * 30 + " ".join(words[7000:7015]) + " y" * 20_000, 5, None), (2, "b " * 15_000, 6, "a"), (3, "nothing of it", 7, None)]
    began = time.time()
    got = found(spark, docs, items)
    assert got == {1: (20_045, 15, ["1"], True), 2: (15_000, 15_000, ["2"], True), 3: (3, 0, [], False)}
    assert time.time() - began < 120


def test_many_items_with_one_window(spark):
    same = "one two three four five six seven eight nine ten"
    items = [(i, f"{same} and {i}", 0) for i in range(300)]
    docs = [(i, f"number {i} {same} twice {same}", 0, None) for i in range(300)]
    got = found(spark, docs, items)
    assert all(got[i] == overlap_truth(t, [(j, x) for j, x, _ in items]) for i, t, *_ in docs[:3])
    every = sorted(map(str, range(300)))
    assert all(x[1:] == (20, every, True) for x in got.values())


def test_plan_computes_arrays_once(spark):
    """No operator's expressions hold more hash calls than one pass over a text needs."""
    d = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    rows, hits = decontaminate.find_overlaps(d, d.select("doc_id", "text").withColumnRenamed("doc_id", "item_id"))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        rows.explain("extended")
        hits.explain("extended")
    assert "xxhash64" not in out.getvalue().split("== Physical Plan ==")[-1] and hits.count() == 2
