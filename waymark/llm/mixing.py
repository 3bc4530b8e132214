"""Mixing sources to target weights by hash thresholds, without sorting documents.

Each document gets a fixed 60-bit number from its id. A source that must give a part of its words gives the documents whose
number lies below a threshold. The threshold is found from histograms: words by source and bucket of the number's leading
bits; the running sum shows in which bucket the budget ends; only that bucket is split by the next bits, and so on. Buckets
nest, so that a larger budget always takes a superset. At the end one filter applies the thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import small, stage, utf8

BITS, STEP = 60, 12


def n_words(col: str | Column) -> Column:
    """White-space separated words of a text; 0 for null."""
    return F.regexp_count(utf8(col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def draw(col: str | Column) -> Column:
    """A number of 60 bits from an id: the first 15 hexadecimal digits of the MD5 of its text. A null id counts as ''."""
    c = F.col(col) if isinstance(col, str) else col
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def water_level(sources: DataFrame, weights: tuple[int, ...], budget: float, most: float) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares of budget x all sizes by weight, none above most x its source's size.

    What a capped source cannot take goes to the others by weight until none is above: each gets min(cap, level x weight).
    Sources are capped in the order of cap / weight, so running sums over the sources give the level. Weights repeat over the
    sources by code point, null last. One row a source, so one task orders them.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    s = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    up = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(every) * budget - F.coalesce(F.sum("cap").over(up), F.lit(0.0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), F.lit(0.0))
    # The level if all sources before this one are capped. It rises as long as capping the next one frees words, and falls
    # from then on: the highest is the right one.
    s = s.withColumn("level", rest / left)
    return s.select("source", "source_size", F.least("cap", F.max("level").over(every) * F.col("weight")).alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, base, below): a document of the source is taken base times, and once more if its draw is under ``below``.

    The running sum over each source's histogram finds the bucket in which the budget ends; the next round splits that bucket
    only. After the last bits a bucket holds one draw; it goes in if that brings the sum nearer to the target.
    """
    t = targets.withColumn("base", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)).cast("long"))
    t = t.withColumn("need", F.col("target") - F.col("base") * F.col("source_size")).withColumn("below", F.lit(0).cast("long"))
    t = stage(t.select("source", "base", "need", "below"), "mix-level")
    rows = sized.select("source", "size", "draw")
    for shift in range(BITS - STEP, -1, -STEP):
        # rows in the bucket that still matters: all at first, then those that share the leading bits of ``below``
        s = small(t.filter("need > 0").select(F.col("source").alias("t_source"), "below"), 64)  # a source that has its words takes no more
        near = rows.join(s, F.col("source").eqNullSafe(F.col("t_source")))
        near = near.filter(F.shiftright("draw", shift + STEP) == F.shiftright("below", shift + STEP))
        hist = near.groupBy("source", F.shiftright("draw", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        hist = hist.withColumn("after", run).join(small(t.select(F.col("source").alias("t_source"), "need"), 64), F.col("source").eqNullSafe(F.col("t_source")))
        hist = hist.filter(F.col("after") - F.col("words") <= F.col("need"))  # buckets that begin within the budget
        last = hist.groupBy("source").agg(F.max(F.struct("bucket", "words", "after")).alias("x"))
        last = last.select(F.col("source").alias("l_source"), "x.*")
        t = t.join(small(last, 96), F.col("source").eqNullSafe(F.col("l_source")), "left")
        within = F.coalesce(F.col("after") - F.col("words"), F.lit(0))  # words below the bucket
        start = F.coalesce(F.shiftleft("bucket", shift), F.col("below"))
        if shift == 0:
            over = F.col("words") - (F.col("need") - within)  # beyond the budget, if the last bucket goes in; null without one
            start = F.when(over <= F.col("need") - within, start + 1).otherwise(start)
        t = stage(t.select("source", "base", (F.col("need") - within).alias("need"), start.alias("below")), "mix-level")
    return t.select("source", "base", "below")


def cuts(sized: DataFrame, weights: tuple[int, ...], budget: float, most: float) -> DataFrame:
    """(c_source, source_size, target, base, below), a row a source, for rows (source, size, draw)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stage(water_level(sources, weights, budget, most), "mix-targets")
    both = targets.alias("a").join(thresholds(sized, targets).alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    return both.select(F.col("a.source").alias("c_source"), "source_size", "target", "base", "below")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target (its source's), copies, taken (= copies x size).

    Size is the number of white-space words; null texts have 0. A source gives its target to within about half a document
    (documents that share an id are taken together). copies is 0, 1 or 2 with the default ``most``. The choice depends on ids
    alone: reruns and other partitionings agree. Null sources are a source of their own, null ids share one draw. Other
    columns are ignored; an empty table gives no rows.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), draw(id_col).alias("draw"))
    sized = stage(sized, "mix-sized")
    cut = cuts(sized, weights, budget, most)
    out = sized.join(small(cut, 96), F.col("source").eqNullSafe(F.col("c_source")))
    copies = F.col("base") + (F.col("draw") < F.col("below")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs that the mix takes, with all their columns, their size, their source's target, and copies (1 or 2 by default).

    Columns of docs with the names size, target or copies, in any case, are replaced. Null texts have size 0 and are taken
    with their source's draws; an empty table gives no rows.
    """
    sized = docs.select(F.col(source_col).alias("source"), n_words(text_col).alias("size"), draw(id_col).alias("draw"))
    cut = cuts(stage(sized, "mix-sized"), weights, budget, most)
    cut = cut.select(*(F.col(c).alias(f"__mix_{c}") for c in ("c_source", "target", "base", "below")))
    out = docs.join(small(cut, 96), F.col(source_col).eqNullSafe(F.col("__mix_c_source")))
    copies = F.col("__mix_base") + (draw(id_col) < F.col("__mix_below")).cast("long")
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("size", "target", "copies")]
    out = out.filter(copies > 0)
    return out.select(*own, n_words(text_col).alias("size"), F.col("__mix_target").alias("target"), copies.alias("copies"))
