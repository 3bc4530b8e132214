"""Near copies of similarity 0.8 and more on five words, against all pairs."""

import numpy as np
import pytest

from waymark.llm import simhash


def shingles(t, k=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similarity(a, b):
    p, q = shingles(a), shingles(b)
    return len(p & q) / len(p | q) if p or q else 1.0


def changed(rng, ws, n):
    ws = list(ws)
    for k in rng.choice(len(ws), n, replace=False):
        ws[k] = f"new{rng.integers(1 << 40)}"
    return " ".join(ws)


def test_recall_and_precision(spark):
    """Pairs of every similarity: of those at 0.8 or more 0.9 go at least, none below goes."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(4000)]
    rows, pairs = [], []
    for i in range(900):
        ws = rng.choice(words, int(rng.integers(60, 500)))
        rows.append((i, " ".join(ws)))
        rows.append((10_000 + i, changed(rng, ws, int(rng.integers(1, max(2, len(ws) // 25))))))
        pairs.append((i, 10_000 + i, similarity(rows[-2][1], rows[-1][1])))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, node int").repartition(5)
    kept = simhash.near_copies(df)
    assert kept.columns == df.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert all(i in ids for i, _, _ in pairs) and all(j in ids for _, j, s in pairs if s < 0.8)
    for lo, hi in ((0.8, 0.85), (0.85, 0.9), (0.9, 1)):
        some = [j not in ids for _, j, s in pairs if lo <= s < hi]
        print(lo, hi, len(some), sum(some) / len(some))
    close = [j not in ids for _, j, s in pairs if s >= 0.8]
    assert len(close) > 300 and sum(close) >= 0.9 * len(close)


@pytest.mark.parametrize("share", [0.02, 0.004])
def test_a_large_group(spark, share):
    """Two thousand copies of one text: far from each other and only near the original, or near each other."""
    rng = np.random.default_rng(5)
    ws = [f"w{i}" for i in rng.integers(0, 4000, 500)]
    texts = [" ".join(ws)] + [changed(rng, ws, int(500 * share)) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r["doc_id"] for r in simhash.near_copies(df).collect()}
    assert 0 in left and len(left) <= 1 + 0.03 * len(texts)


def test_odd_rows(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, 0), (5, a, 1), (5, b, 2), (None, a, 3), (None, None, 4), (9, "", 5), (8, "one two", 6), (7, "One  TWO", 7), (3, "x " * 200_000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp0 int")
    assert sorted(r["fp0"] for r in simhash.near_copies(df).collect()) == [0, 2, 5, 7, 8]
    assert simhash.near_copies(df.limit(0)).count() == 0
