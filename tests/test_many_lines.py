"""Stops of many lines repaired together, and ways chained by their ends, against the plain versions."""

import time

import numpy as np
import pytest

from waymark.functions.kernels import LINE
from waymark.operators import sequences


def test_many_lines_are_repaired_as_each_alone():
    rng = np.random.default_rng(8)
    moved = 0
    for size in (3, 4, 5, 7, 12):
        x, y = 139 + rng.integers(0, 40, (400, size)) / 40, 35 + rng.integers(0, 40, (400, size)) / 400
        x[::3] = np.sort(x[::3], axis=1)
        x[::6, size // 2] += 0.9
        x[1], y[1] = 139.0, 35.0
        got = sequences.repair_orders(x, y)
        want = np.stack([sequences.repair_order(np.column_stack(v)) for v in zip(x, y, strict=True)])
        assert (got == want).all()
        moved += int((want != np.arange(size)).any(1).sum())
    assert moved > 100


def test_many_lines_cost_little_each():
    rng = np.random.default_rng(9)
    x, y = 139 + rng.random((40000, 5)), 35 + rng.random((40000, 5))
    began = time.process_time()
    sequences.repair_orders(x, y)
    assert time.process_time() - began < 2.5  # one by one, over 10 s


def test_ways_chain_by_their_ends_alone():
    rng = np.random.default_rng(10)
    for n in (1, 2, 9, 60, 400):
        ways = [[(int(a), 0), (int(b), int(c))] for a, b, c in zip(rng.integers(0, n, n), rng.integers(0, n, n), rng.integers(0, 2, n), strict=True)]
        want = sequences.chains(ways)
        got = []
        for part in sequences.chained_ends([w[0] for w in ways], [w[-1] for w in ways]):
            line = [p for k, v in enumerate(part) for p in (ways[v - 1] if v > 0 else ways[-v - 1][::-1])[int(k > 0) :]]
            got.append(line)
        assert got == [line for _, line in want]


@pytest.mark.parametrize("whole", [0, 25, 5000])
def test_small_and_large_relations_chain_alike(spark, whole, monkeypatch):
    called, plain = [], sequences.connected_components
    monkeypatch.setattr(sequences, "connected_components", lambda *a, **k: (called.append(1), plain(*a, **k))[1])
    rng = np.random.default_rng(11)
    rows = [(int(k % 7 % 3), k, [{"x": float(x), "y": float(y)} for x, y in rng.integers(0, 5, (int(rng.integers(2, 4)), 2))]) for k in range(120)]
    df = spark.createDataFrame(rows, f"relation int, ord long, line {LINE.simpleString()}")
    got = {(r["relation"], r["part"]): [(p["x"], p["y"]) for p in r["line"]] for r in sequences.stitch_ways(df, whole=whole).collect()}
    want = {}
    for rel in range(3):
        for n, line in enumerate(sequences.chain([[(p["x"], p["y"]) for p in w] for r, _, w in rows if r == rel])):
            want[rel, n] = line
    assert got == want
    assert bool(called) == (whole < 100)
