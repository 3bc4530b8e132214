"""Steps of the pipeline that cost less than the plain versions kept here, and give the same."""

import re

import numpy as np
from pyspark.sql import functions as F

from waymark.llm import decontaminate, simhash, toxicity
from waymark.llm.common import utf8

ODD = ["", " ", "a", "  A b__c`d{e|f}~g\x7fh\x00i ", "ÀB éİx 日本 \U0001f600z y\x85q", "\t\r\n\x0b1a-2", "Straße ÀÉ ªº²³µ ÿ Ÿ", "İstanbul ǅ ΑΣ", "".join(map(chr, range(256))), "a b a b a b a b a b", "x\x1cy \x1fz"]


def test_words_are_cut_as_the_pattern_says(spark):
    plain = F.regexp_extract_all(F.translate(utf8("text"), decontaminate.UPPER, decontaminate.LOWER), F.lit(f"({decontaminate.WORD})"), F.lit(1))
    got = spark.createDataFrame([(t,) for t in [*ODD, None]], "text string").select(decontaminate.words("text").alias("got"), plain.alias("want")).collect()
    assert all(r["got"] == r["want"] for r in got)
    for t in ODD:
        ws = [w.decode("latin-1") if isinstance(w, bytes) else w for w in toxicity.words_of(t)]
        assert ws == re.findall(r"[^\W_]+", t.lower())
    assert isinstance(toxicity.words_of("ÀB é")[0], bytes) and toxicity.WordHashes()[b"\xe9t\xe9"] == toxicity.WordHashes()["été"]


def test_runs_are_equal_where_their_words_are():
    rng = np.random.default_rng(3)
    texts = [*ODD, *(" ".join(rng.choice(["a", "b", "ab", "é", "Ba", "ba"], n)) for n in (3, 5, 6, 40, 4000))]
    for k in (1, 3, 5):
        p, q = (np.concatenate([f(t, k) for t in texts]) for f in (simhash.shingle_hashes, simhash.run_hashes))
        assert (np.unique(p, return_index=True)[1][np.unique(p, return_inverse=True)[1]] == np.unique(q, return_index=True)[1][np.unique(q, return_inverse=True)[1]]).all()
    for t in texts:
        assert len(simhash.run_hashes(t, 5)) == len(simhash.shingle_hashes(t, 5))


def near_rows(rng, n=300):
    base = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64) * np.uint64(2)
    rows = [base]
    for flips in (3, 14, 20, 28, 30):
        c = base.copy()
        for r in range(n):
            for b in rng.permutation(128)[:flips]:
                c[r, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        rows.append(c)
    t = np.concatenate(rows)
    return t[np.lexsort((t[:, 1], t[:, 0]))]


def test_small_subtrees_are_linked_as_the_walk_links_them(monkeypatch):
    t = near_rows(np.random.default_rng(4))
    for depth, pairs in ((4, 1 << 19), (6, 1000)):
        monkeypatch.setattr(simhash, "PAIRS", pairs)
        roots = simhash._ranges(t[:, 0] >> np.uint64(64 - depth))
        sets, walked = simhash.Joined(len(t)), None
        simhash.meet(t, roots, 28, sets)
        for budget in (14, 28):
            walked = simhash.walk(t, roots, depth, budget, walked)
        at = np.arange(len(t))
        assert (sets.roots(at) == walked.roots(at)).all()
        edges = np.concatenate(sets.edges)
        assert (simhash.differing(t, edges[:, 0], edges[:, 1]) <= 28).all() and len(set(edges[:, 2].tolist())) == len(edges)


def test_the_walk_is_left_to_large_subtrees(monkeypatch, spark):
    t = near_rows(np.random.default_rng(5), 20)
    orders = simhash.random_orders(2, 3)
    frame = spark.createDataFrame([tuple(r) for r in t.view(np.int64).tolist()], "fp0 long, fp1 long").distinct()
    edges = lambda: simhash.trie_edges(frame, ["fp0", "fp1"], orders, 4, [14, 28]).select(F.xxhash64("fp0_a", "fp1_a").alias("a"), F.xxhash64("fp0_b", "fp1_b").alias("b"))
    groups = lambda: {(r["node"], r["root"]) for r in simhash.components(edges()).collect()}
    plain = groups()
    monkeypatch.setattr(simhash, "LEAF", 1)
    assert len(plain) > 40 and groups() == plain
