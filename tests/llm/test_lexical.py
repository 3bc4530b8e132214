"""Ranked search against scores computed one by one."""

import math
import random
import re

import pytest

from waymark.llm import lexical

RUN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return RUN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """Every score of every pair, as the contract puts it."""
    bags = [(d, words(t)) for d, t in docs]
    bags = [(d, w) for d, w in bags if w]
    n_docs, total = len(bags), sum(len(w) for _, w in bags)
    df = {}
    for _, w in bags:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for d, w in bags:
            m = 75 + (25 * len(w) * n_docs) // total
            s = 0
            for t in words(text):
                if tf := w.count(t):
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            if s:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def searched(spark, docs, items, k, pruned=True, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id string, text string")
    got = lexical.search(lexical.build_index(d, q if pruned else None), q, k, **more)
    return sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    common, rare = ["the", "of", "Über", "straße", "x1"], [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(rng.randint(0, 40)))) for i in range(n)]
    items = [(f"q{i}", " ".join(rng.choice([*common, *rare]) for _ in range(rng.randint(0, 9)))) for i in range(30)]
    return docs, items


@pytest.mark.parametrize("short", [0.0, 0.05, 1.0])
@pytest.mark.parametrize("pruned", [True, False])
def test_equals_all_scores_one_by_one(spark, monkeypatch, short, pruned):
    docs, items = corpus(5, 900)
    assert searched(spark, docs, items, 7, pruned, short=short) == plain(docs, items, 7)


def test_windows_and_blocks_skip_without_loss():
    """Many small blocks with the floor carried over, against one by one: Block.best keeps all that can be among the best."""
    import numpy as np
    import pyarrow as pa
    from collections import Counter

    docs, items = corpus(9, 3000)
    bags = [(len(w := words(t)), [(x.encode(), n) for x, n in Counter(w).items()]) for _, t in docs]
    block = lexical.Block(lexical._block(list(range(len(docs))), bags, pa.int64()), 0, len(docs), sum(n for n, _ in bags))
    for _, text in items:
        weights = [(t.encode(), 3 + len(t)) for t in words(text)]
        docs_at, scores = block.best(weights, 5, 1, 0.02)
        full = np.zeros(len(docs), np.int64)
        for t, w in weights:
            if t in block.names:
                at, value, *_ = block.long_list(block.names[t])
                full[at] += value * w
        want = sorted(((-s, d) for d, s in enumerate(full) if s))[:5]
        assert sorted((-s, d) for d, s in zip(docs_at, scores, strict=True))[:5] == want


def test_nulls_ties_repeats_and_clashing_names(spark):
    docs = [(3, "Alpha beta"), (1, "alpha BETA"), (1, "alpha beta"), (None, "alpha beta"), (7, None), (8, ""), (9, "gamma")]
    items = [("a", "alpha alpha BETA"), ("a", "alpha alpha BETA"), ("b", None), ("c", "..."), (None, "gamma"), ("d", "nothing here")]
    assert searched(spark, docs, items, 3) == plain(docs, items, 3)
    d = spark.createDataFrame([(1, "alpha", "x", 5)], "doc_id long, text string, item_id string, score int")
    q = spark.createDataFrame([("a", "alpha", 1, 2)], "item_id string, text string, doc_id int, rank int")
    assert [r["rank"] for r in lexical.search(lexical.build_index(d, q), q).collect()] == [1]


def test_empty_tables_and_groups_of_queries(spark, monkeypatch):
    docs, items = corpus(3, 200)
    assert searched(spark, [], items, 5) == [] and searched(spark, docs, [], 5) == []
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 2000)  # neither the terms nor the queries fit
    assert searched(spark, docs, items, 5) == plain(docs, items, 5)


def test_a_very_long_text(spark):
    docs = [(1, "alpha " * 300_000 + "omega"), (2, "omega"), (3, "alpha")]
    assert searched(spark, docs, [("q", "omega alpha")], 5) == plain(docs, [("q", "omega alpha")], 5)
