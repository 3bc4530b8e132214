"""Spelling variants: words of a corpus, which of them differ by one code point, and the form that each is a variant of.

Near words meet through an index of variable-length grams:

1. a dictionary of frequent grams of ``SHORTEST`` + 1 to ``LONGEST_GRAM`` code points over the words, framed by two marks;
   a gram enters if it occurs often enough that at most ``most`` of a length can, so the dictionary's size is bounded;
2. a word is decomposed into the longest dictionary gram at each place (``SHORTEST`` code points where there is none), less
   those inside an earlier one;
3. for each place of an edit the grams that it can touch are counted: those across it, those to its left that a longer
   dictionary gram could replace, and those to its right that a gram begun before could swallow. With ``lost`` the largest
   such count, a word shares at least (its grams - lost) grams with any near word;
4. lists are merged with that bound: with grams in order of rarity, two near words share, among each one's (lost + 2) rarest,
   two grams at places that one edit explains, if both must share two at least; else one among the (lost + 1) rarest. So the lists
   joined are those of pairs of rare grams with their places and the word's length, and words that meet are compared.

Words of which every gram can be lost get no bound from the index; pairs of two such words meet by the word less one code
point, which is exact as well.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import stage, utf8

SHORTEST, LONGEST_GRAM = 2, 3
#: Marks before and after a word; no word has them.
BEGIN, END = "\x02", "\x03"
_RUNS = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
#: A task sends its counts on when it holds so many words.
HELD = 1 << 18


def _counted(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()
    make = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            start = zlib.crc32(f"{doc_id}:".encode())
            for run, n in Counter(_RUNS.findall(text.as_py().translate(_LOWER))).items():
                h = zlib.crc32(run.encode(), start)
                if h % every == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]  # noqa: PLW2901
                held[run] += n
            if len(held) > HELD:
                yield make(held)
                held.clear()
    yield make(held)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_n: int = 3, every: int = 97) -> DataFrame:
    """word, n: distinct words of all texts, with at least ``least_chars`` code points and ``least_n`` occurrences.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. Where ``every`` divides the unsigned crc32 h of
    "<id>:<run>", one code point of the run, number h modulo its length, is left out: variants made on purpose. A null id is
    written "None", a null text has no words. Tasks count before anything is shuffled, by parts of bounded size.
    """
    slim = docs.select(F.col(id_col).cast("string").alias("doc_id"), utf8(text_col).alias("text"))
    counts = slim.mapInArrow(lambda it: _counted(it, every), "word string, n long").filter(F.char_length("word") >= least_chars)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def gram_dictionary(words: DataFrame, most: int = 1 << 14, least: int = 64) -> dict[str, int]:
    """Grams with their occurrences over the distinct words: all of SHORTEST code points (at most the square of the alphabet), and of
    each greater length up to LONGEST_GRAM those with ``least`` occurrences, and enough that no more than ``most`` can have as many."""
    framed = words.select(F.concat(F.lit(BEGIN), "word", F.lit(END)).alias("w"))
    lengths = F.array(*(F.lit(q) for q in range(SHORTEST, LONGEST_GRAM + 1)))
    grams = framed.select("w", F.explode(lengths).alias("q")).filter(F.char_length("w") >= F.col("q"))
    grams = grams.select("q", F.explode(F.expr("transform(sequence(1, char_length(w) - q + 1), i -> substr(w, i, q))")).alias("gram"))
    counts = stage(grams.groupBy("q", "gram").agg(F.count(F.lit(1)).alias("n")), "gram-counts")
    totals = {r["q"]: r["n"] for r in counts.filter(F.col("q") > SHORTEST).groupBy("q").agg(F.sum("n").alias("n")).collect()}
    enough = F.coalesce(*(F.when(F.col("q") == q, F.lit(max(least, -(-n // most)))) for q, n in totals.items()), F.lit(0))
    return {r["gram"]: r["n"] for r in counts.filter(F.col("n") >= enough).select("gram", "n").collect()}


class Decomposer:
    """Variable-length grams of a word, and how many of them one edit can touch at most."""

    def __init__(self, dictionary: Iterable[str]):
        dictionary = [g for g in dictionary if len(g) > SHORTEST]
        self.grams = set(dictionary)
        self.heads = {g[:i] for g in dictionary for i in range(1, len(g))}  # what a gram can begin with
        self.tails = {g[i:] for g in dictionary for i in range(1, len(g))}  # what a gram can end with

    def split(self, word: str) -> list[tuple[int, str]]:
        s, out, end = BEGIN + word + END, [], 0
        for p in range(len(s) - SHORTEST + 1):
            q = next((q for q in range(min(LONGEST_GRAM, len(s) - p), SHORTEST, -1) if s[p : p + q] in self.grams), SHORTEST)
            if p + q > end:
                out.append((p, s[p : p + q]))
                end = p + q
        return out

    def lost(self, word: str, grams: list[tuple[int, str]]) -> int:
        """The most grams that inserting, deleting or replacing one code point can touch.

        The text left of ``a`` and right of ``b`` stays. A gram across the edit is touched; one that ends at or before a only
        if some gram begins at or before it and could go on past a; one that begins at or after b only if the text from b to its end,
        or further, can be the end of a gram begun before b.
        """
        s, most = BEGIN + word + END, 0
        spans = [(p, p + len(g)) for p, g in grams]
        for a in range(1, len(s)):
            left = next((p for p in range(max(0, a - LONGEST_GRAM + 1), a) if s[p:a] in self.heads), a)
            for b in (a, a + 1):  # an insertion between a - 1 and a; a itself replaced or deleted
                if b > len(s) - 1:
                    continue
                right = next((e for e in range(min(len(s), b + LONGEST_GRAM - 1), b, -1) if s[b:e] in self.tails), b)
                most = max(most, sum((p < b and e > a) or (e <= a and p >= left) or (p >= b and e <= right) for p, e in spans))
        return most


#: A list's key adds up the numbers of two grams, the word's length and the grams' places, so that moving a place adds a constant.
#: Fields may run over in very long words: such keys meet more words, never fewer.
FIRST, SECOND, LENGTH, PLACE = 1 << 45, 1 << 30, 1 << 20, 1 << 10


def _keys(word: str, grams: list[tuple[int, str]], need: int, rank: dict[str, int]) -> tuple[list[int], list[int]]:
    """Keys of the lists that a word enters: of pairs of its rare grams, and of single ones."""
    rare = sorted((rank[g], p) for p, g in grams)
    size = LENGTH * len(word)
    ones = [FIRST * r + size + p for r, p in (rare[: len(grams) - need + 1] if need > 0 else rare)]
    if need < 2:
        return [], ones
    some = sorted((p, r) for r, p in rare[: len(grams) - need + 2])
    return [FIRST * r + SECOND * t + size + PLACE * p + q for i, (p, r) in enumerate(some) for q, t in some[i + 1 :]], ones


def _decomposed(batches: Iterator[pa.RecordBatch], dictionary: dict[str, int]) -> Iterator[pa.RecordBatch]:
    d = Decomposer(dictionary)
    rank = {g: i for i, (_, g) in enumerate(sorted((n, g) for g, n in dictionary.items()))}
    for batch in batches:
        pairs, ones, need = [], [], []
        for word in batch.column(0).to_pylist():
            grams = d.split(word)
            need.append(len(grams) - d.lost(word, grams))
            two, one = _keys(word, grams, need[-1], rank)
            pairs.append(two)
            ones.append(one)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(need, pa.int32()), pa.array(pairs, pa.list_(pa.int64())), pa.array(ones, pa.list_(pa.int64()))], ["word", "need", "pairs", "ones"])


def decompose(words: DataFrame, dictionary: dict[str, int]) -> DataFrame:
    """word, need (how many grams any near word shares at least; 0 or less: no bound), and the keys of its lists: pairs, ones."""
    shared = words.sparkSession.sparkContext.broadcast(dictionary)
    return words.select("word").mapInArrow(lambda it: _decomposed(it, shared.value), "word string, need int, pairs array<long>, ones array<long>")


def near_pairs(words: DataFrame, most: int = 1 << 14, least: int = 64) -> DataFrame:
    """word, other: each ordered pair of words that differ by exactly one inserted, deleted or replaced code point, once. Words are distinct and not null."""
    lists = stage(decompose(words, gram_dictionary(words, most, least)), "gram-lists")
    near = (F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)

    def meet(left: DataFrame, right: DataFrame, keys: str, moves: list[int]) -> DataFrame:
        """Words whose keys are equal after one of the moves: of length and places, as an edit between, before or after the grams makes them."""
        l = left.select("word", F.explode(keys).alias("key")).select("word", F.explode(F.array(*(F.col("key") + m for m in moves))).alias("key"))  # noqa: E741
        r = right.select(F.col("word").alias("other"), F.explode(keys).alias("key"))
        return l.join(r, "key").filter(near).select("word", "other")

    two = meet(lists, lists, "pairs", [0, LENGTH, LENGTH + 1, LENGTH + PLACE + 1])
    one = meet(lists.filter("need <= 1"), lists, "ones", [0, LENGTH, LENGTH + 1, -LENGTH, -LENGTH - 1])
    # words without a bound, among themselves
    free = lists.filter("need <= 0").select("word")
    less = F.expr("transform(sequence(1, char_length(word)), i -> concat(substr(word, 1, i - 1), substr(word, i + 1)))")
    cut = free.select("word", F.explode(F.array_distinct(F.array_append(less, F.col("word")))).alias("key"))
    unbound = cut.join(cut.withColumnRenamed("word", "other"), "key").filter(near).select("word", "other")
    found = two.unionByName(one).unionByName(unbound)
    once = stage(found.select(F.least("word", "other").alias("word"), F.greatest("word", "other").alias("other")).distinct(), "near-words")
    return once.unionByName(once.select(F.col("other").alias("word"), F.col("word").alias("other")))


def group_variants(words: DataFrame, times: int = 2, most: int = 1 << 14, least: int = 64) -> DataFrame:
    """word, n, n_near, form, form_n, root for distinct words with their counts n.

    A word's form is its near word of largest n, ties by the smallest in code-point order, if that n is at least ``times`` the
    word's; else null. The root is the last word that following forms leads to, the word itself if there is none. An empty table gives an
    empty result.
    """
    words = stage(words.select("word", "n"), "words")
    pairs = near_pairs(words, most, least)
    others = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = pairs.join(others, "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("b"))
    linked = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("b.less") >= times * F.col("n"), F.col("b.other")).alias("form"), F.when(-F.col("b.less") >= times * F.col("n"), -F.col("b.less")).alias("form_n"))
    linked = stage(linked, "forms")
    # counts grow at least ``times``-fold along forms, which bounds the way to the root; each round doubles what is behind
    top = linked.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(max(top, times), times)))
    roots = linked.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(steps)))):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stage(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return linked.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
