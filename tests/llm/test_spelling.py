"""Variants against edit distances computed pair by pair."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from waymark.llm import spelling


def counted(docs):
    """Word counts as the contract puts them."""
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def cuts(w):
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}


def grouped(counts):
    meet = {}
    for w in counts:
        for c in cuts(w):
            meet.setdefault(c, []).append(w)
    near = {w: set() for w in counts}
    for ws in meet.values():
        for a, b in itertools.combinations(ws, 2):
            if one_apart(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def vocabulary(seed, n, letters):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(4, 11))) for _ in range(n)}
    for w in list(words):
        for _ in range(3):
            i, c = rng.randrange(len(w) + 1), rng.choice(letters)
            words |= {w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]}
    return {w: rng.choice([3, 4, 6, 9, 20, 50, 200]) for w in words if len(w) >= 3}


@pytest.mark.parametrize(("letters", "most", "least"), [("abcdefghijklmnopé", 1 << 14, 8), ("ab", 1 << 14, 4), ("abcde", 1 << 14, 1 << 30), ("abcdef", 16, 1), ("abcdefghijklmnopqrstuvwxyz", 1 << 14, 3)])
def test_forms_roots_and_counts(spark, letters, most, least):
    counts = vocabulary(len(letters), 250, letters)
    got = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), 2, most, least)
    assert rows(got) == grouped(counts)


def test_the_bound_holds_for_every_edit():
    """No edit touches more grams than ``lost`` says, whatever the dictionary."""
    rng = random.Random(4)
    for _ in range(60):
        letters = rng.choice(["ab", "abcd", "abcdefgh"])
        word = lambda n: "".join(rng.choice(letters) for _ in range(n))
        d = spelling.Decomposer([g for g in {word(rng.choice([3, 4])) for _ in range(rng.choice([0, 5, 40, 200]))}] + [spelling.BEGIN + word(2), word(2) + spelling.END])
        for _ in range(15):
            w = word(rng.randint(1, 10))
            grams = d.split(w)
            least = len(grams) - d.lost(w, grams)
            have = Counter(g for _, g in grams)
            edits = {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) for c in ["", *letters, "z"] if j <= len(w)} - {w}
            for e in edits:
                assert sum((have & Counter(g for _, g in d.split(e))).values()) >= least, (w, e)


def test_words_and_their_planted_variants(spark):
    rng = random.Random(7)
    some = ["Spelling", "variants", "Straße", "été", "ÉTÉS", "ab", "déjà", "naïveté", "x×y÷z", "l'orange", "42abcde"]
    docs = [(i, " ".join(rng.choice(some) for _ in range(40))) for i in range(400)] + [(401, None), (402, ""), (None, "nulls nulls nulls")]
    df = spark.createDataFrame([(a, b, "clash", 1) for a, b in docs], "doc_id long, text string, word string, n int").repartition(3)
    got = {r["word"]: r["n"] for r in spelling.word_counts(df).collect()}
    assert got == counted(docs) and any(len(w) == 7 for w in got)


def test_counts_sent_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    docs = [(i, "first second third fourth fifth sixth") for i in range(20)]
    assert {w: n for batch in spelling._counted(iter([batch_of(docs)]), 97) for w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True) if len(w) >= 5}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["word"]: r["n"] for r in spelling.word_counts(df).collect()} == counted(docs)


def batch_of(docs):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([str(d) for d, _ in docs]), pa.array([t for _, t in docs])], ["doc_id", "text"])


def test_empty_and_lone_words(spark):
    assert rows(spelling.group_variants(spark.createDataFrame([], "word string, n long"))) == []
    assert spelling.word_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert rows(spelling.group_variants(spark.createDataFrame([("alone", 3)], "word string, n long"))) == [("alone", None, "alone", 3, 0, None)]


def test_a_very_long_text_and_a_very_long_word(spark):
    docs = [(1, "abcdefgh " * 100_000 + ("y" * 5000 + " ") * 4), (2, ("y" * 4999 + " ") * 9)]
    counts = counted(docs)
    words = spelling.word_counts(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["word"]: r["n"] for r in words.collect()} == counts
    assert rows(spelling.group_variants(words)) == grouped(counts)


def test_registered_query_over_the_whole_table(spark):
    from waymark.llm.queries import op13_spelling_variants

    sf_dir = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows(op13_spelling_variants(spark, sf_dir)) == grouped(counted(docs))
