"""Benchmark decontamination by winnowing, in DataFrame operations only.

Both sides keep, of every run of ``window - k + 1`` consecutive k-grams, the smallest k-gram hash. Any span of ``window``
words that a document shares with an item therefore leaves the same fingerprint on both sides: joining fingerprints loses
none. Each hit is then extended: the document's windows around the shared k-gram are looked up among the items' windows by
their words, and only equal windows count. Items shorter than a window are looked up whole. Work and rows grow with the
lengths of documents and items, not with their product: a window that many items share is one row.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import measured, stage, utf8

#: Fixed value: what a word is, after A-Z became a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters outside words; all are ASCII.
BETWEEN = "".join(c for c in map(chr, range(128)) if c not in UPPER and not re.fullmatch(WORD, c))


def words(col: str | Column) -> Column:
    """The words of a text, in order; none for null. Cutting at spaces costs a tenth of a regular expression's matches."""
    plain = F.translate(utf8(col), UPPER + BETWEEN, LOWER + " " * len(BETWEEN))
    return F.array_remove(F.split(plain, " "), "")


def _upto(last: Column) -> Column:
    """0, 1, ... last; no entries if last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def gram_hashes(ws: Column, k: int) -> Column:
    """A 64-bit hash of each run of k words; ws holds words or hashes of words."""
    return F.transform(_upto(F.size(ws) - k), lambda i: F.xxhash64(*(F.get(ws, i + j) for j in range(k))))


def winnow(df: DataFrame, ws: str, k: int, run: int, out: str) -> DataFrame:
    """Adds ``out``: the distinct smallest hashes of each ``run`` consecutive k-grams of ws; of all, if there are fewer.

    Each step is a column of its own: an array that a lambda reads must not be computed inside it, once an entry.
    """
    df = df.withColumn("__grams", gram_hashes(F.col(ws), k))
    g = F.col("__grams")
    least = F.transform(_upto(F.size(g) - run), lambda i: F.least(*(F.get(g, i + j) for j in range(run))))
    few = (F.size(g) > 0) & (F.size(g) < run)
    return df.withColumn(out, F.array_distinct(F.when(few, F.array(F.array_min(g))).otherwise(least))).drop("__grams")


def least_places(g: Column, run: int) -> Column:
    """Where the smallest of each ``run`` consecutive entries stands (the first of equals), each place once; of all, if there are fewer."""
    one = lambda i, n: i + F.array_position(F.slice(g, i + 1, n), F.array_min(F.slice(g, i + 1, n))).cast("int") - 1
    few = (F.size(g) > 0) & (F.size(g) < run)
    return F.array_distinct(F.when(few, F.array(one(F.lit(0), F.size(g)))).otherwise(F.transform(_upto(F.size(g) - run), lambda i: one(i, F.lit(run)))))


def grams(ws: Column, k: int) -> Column:
    """Each run of k words as one text; words hold no space, so equal texts are equal runs."""
    return F.transform(_upto(F.size(ws) - k), lambda i: F.array_join(F.slice(ws, i + 1, k), " "))


def _texts_at(starts: Column, size: int) -> Column:
    """``spots``: (start, w) for the runs of ``size`` words of dw at these places."""
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_join(F.slice("dw", s + 1, size), " ").alias("w"))).alias("spots")


def item_windows(items: DataFrame, window: int, item_col: str, item_text_col: str) -> tuple[DataFrame, list[int]]:
    """(item_id, ws, wh, size) of all items with words, repeats once; and the sizes under ``window`` that occur."""
    it = items.select(F.col(item_col).alias("item_id"), words(item_text_col).alias("ws")).filter(F.size("ws") > 0).distinct()
    it = it.select("item_id", "ws", F.transform("ws", lambda w: F.xxhash64(w)).alias("wh"), F.least(F.size("ws"), F.lit(window)).alias("size"))
    it = stage(it, "decon-items")
    return it, sorted(r["size"] for r in it.select("size").distinct().collect() if r["size"] < window)


def find_overlaps(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, hits): documents has a row for each row of docs: doc_id, content (hash of the text), n_words; hits has
    doc_id, content, start, size and item_ids (all items with that window) for each occurrence of a window in a document.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.
    """
    run = window - k + 1
    it, short = item_windows(items, window, item_col, item_text_col)

    # Item side. The arrays are staged before they are exploded: the filter that Spark derives for an explode would compute
    # them anew inside their own lambdas.
    long_prints = winnow(it.filter(F.col("size") == window).select("wh"), "wh", k, run, "prints").select("prints")
    keys = [long_prints, *(it.filter(F.col("size") == m).select(gram_hashes(F.col("wh"), m).alias("prints")) for m in short)]
    staged = stage(reduce(DataFrame.union, keys), "decon-item-prints")
    keys = measured(stage(staged.select(F.explode("prints").alias("h")).distinct(), "decon-keys"))
    texts = [it.filter(F.col("size") == m).select("item_id", "size", grams(F.col("ws"), m).alias("windows")) for m in [*short, window]]
    texts = stage(reduce(DataFrame.union, texts), "decon-item-windows")
    windows = texts.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "size", F.explode("windows").alias("w"))
    windows = measured(stage(windows.groupBy("size", "w").agg(F.collect_set("item_id").alias("item_ids")), "decon-windows"))

    # One pass over all documents: words, their hashes, fingerprints.
    d = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("content"), words("text").alias("dw"))
    d = d.select("doc_id", "content", F.size("dw").alias("n_words"), F.transform("dw", lambda w: F.xxhash64(w)).alias("wh"))
    d = winnow(d, "wh", k, run, "prints")
    d = d.withColumn("prints", F.array_distinct(F.concat("prints", *(gram_hashes(F.col("wh"), m) for m in short)))) if short else d
    d = stage(d.select("doc_id", "content", "n_words", "prints"), "decon-documents")
    near = d.select("doc_id", "content", F.explode("prints").alias("h")).join(keys, "h", "left_semi")
    near = measured(stage(near.select(F.col("doc_id").alias("c_id"), F.col("content").alias("c_content")).distinct(), "decon-found"))

    # Only documents with a shared fingerprint are read as words again. Around each shared k-gram the windows that hold it
    # are looked up as texts; the k-grams in question are the fingerprints' alone, on either side.
    t = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text")).withColumn("content", F.xxhash64("text"))
    t = t.join(near, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("content") == F.col("c_content")), "left_semi")
    t = t.dropDuplicates(["doc_id", "content"]).select("doc_id", "content", words("text").alias("dw"))
    t = t.withColumn("wh", F.transform("dw", lambda w: F.xxhash64(w)))
    t = t.withColumn("grams", gram_hashes(F.col("wh"), k))
    t = stage(t.select("doc_id", "content", "dw", "grams", least_places(F.col("grams"), run).alias("places")), "decon-near")
    at = t.select("doc_id", "content", F.explode("places").alias("p"), F.get("grams", F.col("p")).alias("h")).join(keys, "h", "left_semi")
    at = at.groupBy("doc_id", "content").agg(F.collect_set("p").alias("at")).withColumnsRenamed({"doc_id": "a_id", "content": "a_content"})
    spots = t.join(at, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("content") == F.col("a_content")))
    starts = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(F.greatest(p - (run - 1), F.lit(0)), p))))
    starts = F.filter(starts, lambda s: s + window <= F.size("dw"))
    looked = [spots.select("doc_id", "content", F.lit(window).alias("size"), _texts_at(starts, window))]
    looked += [t.select("doc_id", "content", F.lit(m).alias("size"), _texts_at(_upto(F.size("dw") - m), m)) for m in short]
    looked = stage(reduce(DataFrame.union, looked), "decon-spots").select("doc_id", "content", "size", F.inline("spots"))
    hits = looked.join(windows, ["size", "w"]).select("doc_id", "content", "start", "size", "item_ids")
    return d.select("doc_id", "content", "n_words"), hits


def covered(starts: Column) -> Column:
    """Words in the union of spans: starts is an array of (start, end), end exclusive."""
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["last"], x["start"]))).alias("n"), F.greatest(acc["last"], x["end"]).alias("last")
    )
    return F.aggregate(F.array_sort(starts), F.struct(F.lit(0).alias("n"), F.lit(0).alias("last")), step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_hit (words inside any occurrence of a window), n_items, item_ids (sorted as
    strings), contaminated.

    Null texts have no words. Rows that repeat an id and text get equal results; null ids are kept. Items without words
    match nothing; items that repeat an id count once, a null item id as ''. Other columns are ignored; empty tables give no
    hits. Texts and items may be of any length.
    """
    rows, hits = find_overlaps(docs, items, window, k, id_col, text_col, item_col, item_text_col)
    spans = hits.groupBy("doc_id", "content").agg(
        covered(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
    )
    s = measured(stage(spans.withColumnsRenamed({"doc_id": "s_id", "content": "s_content"}), "decon-spans"))
    out = rows.join(s, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("content") == F.col("s_content")), "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no window of an item, with all their columns."""
    _, hits = find_overlaps(docs, items, window, k, id_col, text_col, item_col, item_text_col)
    gone = measured(stage(hits.select(F.col("doc_id").alias("__id"), F.col("content").alias("__content")).distinct(), "decon-gone"))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(utf8(text_col)) == F.col("__content"))
    return docs.join(gone, same, "left_anti")
