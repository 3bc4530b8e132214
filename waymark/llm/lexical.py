"""Ranked lexical search of a query set over all documents, with exact 64-bit integer scores.

The index is cut by documents: a block holds some thousand documents of one task, their lengths and, for each term, a sorted
list of (document, occurrences). Two passes over it follow: one adds up documents, lengths and document frequencies, one
ranks. Ranking a query in a block is a hybrid:

* lists that are short for the block are summed term at a time into accumulators, materialised as one sorted list;
* that list is then one more iterator, bounded by its largest sums, beside the long lists. Documents are visited in windows
  of ``WINDOW``; a window whose bounds (the largest value of each iterator in it) cannot reach the lowest of the best k so
  far is skipped, and its postings in the long lists are never read.

The best k of a task go on, so what is shuffled is k rows a query and task, cut again before the final ranking.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import BROADCAST_BYTES, stage, utf8

#: Documents of a window.
WINDOW = 128
#: A block ends after so many documents or so many bytes of text.
BLOCK_DOCS, BLOCK_BYTES = 1 << 13, 1 << 25
#: Term bytes: letters and digits in ASCII, A-Z lower-cased, and all bytes of other characters; the rest separates.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _index_schema(id_type: T.DataType) -> T.StructType:
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    return T.StructType([T.StructField(n, t) for n, t in (("ids", T.ArrayType(id_type)), ("lengths", longs), ("terms", T.ArrayType(T.BinaryType())), ("edges", ints), ("docs", ints), ("counts", ints))])


def _block(ids: list, bags: list[tuple[int, list[tuple[bytes, int]]]], id_type: pa.DataType) -> pa.RecordBatch:
    number: dict[bytes, int] = {}
    term, doc, count = [], [], []
    for i, (_, bag) in enumerate(bags):
        for t, n in bag:
            term.append(number.setdefault(t, len(number)))
            doc.append(i)
            count.append(n)
    order = np.argsort(np.array(term, np.int64), kind="stable")
    edges = np.searchsorted(np.array(term, np.int64)[order], np.arange(len(number) + 1))
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [one(ids, id_type), one([n for n, _ in bags], pa.int64()), one(list(number), pa.binary()), one(edges, pa.int32()), one(np.array(doc, np.int32)[order], pa.int32()), one(np.array(count, np.int32)[order], pa.int32())],
        ["ids", "lengths", "terms", "edges", "docs", "counts"],
    )


def build_index(docs: DataFrame, queries: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", query_col: str = "text") -> DataFrame:
    """The index of all documents with at least one term, a row a block; nothing is shuffled.

    Lengths count all terms. With ``queries``, only lists of terms that occur in their texts are kept, provided that those
    terms fit a broadcast; else all lists are. A null text has no terms. A text of any length is one entry of its block.
    """
    wanted = None
    if queries is not None:
        mine = queries.select(utf8(query_col).alias("text")).mapInArrow(_distinct_terms, "term binary").distinct()
        mine = stage(mine, "query-terms")
        n, size = mine.agg(F.count(F.lit(1)), F.sum(F.octet_length("term"))).first()
        if (size or 0) + 64 * n <= BROADCAST_BYTES:
            wanted = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r[0]) for r in mine.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bags, held, id_type = [], [], 0, None
        keep = wanted.value if wanted else None
        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms(text.as_py())
                if not found:
                    continue
                bag = Counter(found if keep is None else filter(keep.__contains__, found))
                ids.append(doc_id)
                bags.append((len(found), list(bag.items())))
                held += len(found) * 8
                if len(ids) >= BLOCK_DOCS or held >= BLOCK_BYTES:
                    yield _block(ids, bags, id_type)
                    ids, bags, held = [], [], 0
        if ids:
            yield _block(ids, bags, id_type)

    slim = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text"))
    return stage(slim.mapInArrow(run, _index_schema(slim.schema["doc_id"].dataType)), "lexical-index")


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {t for text in batch.column(0).to_pylist() for t in terms(text)}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], ["term"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of each task's blocks, in parts of bounded size, without terms of no document."""
    held: Counter[bytes] = Counter()
    make = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["term", "df"])
    for batch in batches:
        for names, edges in zip(batch.column(0), batch.column(1), strict=True):
            held.update(dict(zip(names.as_py(), np.diff(edges.values.to_numpy()).tolist(), strict=True)))
            if len(held) > 1 << 19:
                yield make(held)
                held.clear()
    yield make(held)


class Block:
    """One block of the index, with what its queries share: each posting's value before the term's weight."""

    def __init__(self, batch: pa.RecordBatch, row: int, documents: int, total: int):
        ids, lengths, names, edges, docs, counts = (batch.column(i)[row] for i in range(6))
        self.ids, self.names = ids.values, {t: i for i, t in enumerate(names.as_py())}
        n, tf = lengths.values.to_numpy().astype(np.int64), counts.values.to_numpy().astype(np.int64)
        self.edges, self.docs, self.size = edges.values.to_numpy(), docs.values.to_numpy().astype(np.int64), len(n)
        norm = 100 - 25 + (25 * n * documents) // max(total, 1)
        self.value = (1_000_000_000 * tf) // (1000 * tf + 12 * norm[self.docs])
        self.windows = -(-self.size // WINDOW)
        self.lists: dict[int, tuple] = {}

    def long_list(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents, values, where each window begins, and each window's largest value."""
        if i not in self.lists:
            cut = slice(self.edges[i], self.edges[i + 1])
            docs, value = self.docs[cut], self.value[cut]
            self.lists[i] = (docs, value, *self._windowed(docs, value))
        return self.lists[i]

    def _windowed(self, docs: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(docs, np.arange(self.windows + 1) * WINDOW)
        most = np.zeros(self.windows, np.int64)
        full = np.flatnonzero(np.diff(at))
        if len(full):
            most[full] = np.maximum.reduceat(value, at[full])
        return at, most

    def best(self, weights: list[tuple[bytes, int]], k: int, floor: int, short: float) -> tuple[np.ndarray, np.ndarray]:
        """Documents (numbers in the block) and scores of at least k best ones, ties with the k-th included; none below ``floor``."""
        brief, iterators = [], []
        for term, w in weights:
            i = self.names.get(term)
            if i is None or not w:
                continue
            if self.edges[i + 1] - self.edges[i] <= short * self.size:
                brief.append((i, w))
            else:
                docs, value, at, most = self.long_list(i)
                iterators.append((docs, value, at, most * w, w))
        if brief:  # term at a time
            docs = np.concatenate([self.docs[self.edges[i] : self.edges[i + 1]] for i, _ in brief])
            value = np.concatenate([self.value[self.edges[i] : self.edges[i + 1]] * w for i, w in brief])
            order = np.argsort(docs, kind="stable")
            docs, first = np.unique(docs[order], return_index=True)
            value = np.add.reduceat(value[order], first)
            at, most = self._windowed(docs, value)
            iterators.append((docs, value, at, most, 1))
        none = np.zeros(0, np.int64)
        if not iterators:
            return none, none
        bound = sum(it[3] for it in iterators)
        order = np.argsort(-bound, kind="stable")
        docs, scores, done, step = none, none, 0, 1
        while done < len(order):  # the most promising windows first, then twice as many, until none can enter
            part = order[done : done + step]
            part = np.sort(part[bound[part] >= max(floor, 1)])
            if not len(part):
                break
            sums = np.zeros(len(part) * WINDOW, np.int64)
            for its, value, at, _, w in iterators:
                size = at[part + 1] - at[part]
                which = np.repeat(np.arange(len(part)), size)
                pick = np.arange(len(which)) + np.repeat(at[part] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
                sums[its[pick] - part[which] * WINDOW + which * WINDOW] += value[pick] * w
            hit = np.flatnonzero(sums >= max(floor, 1))
            docs = np.concatenate((docs, part[hit // WINDOW] * WINDOW + hit % WINDOW))
            scores = np.concatenate((scores, sums[hit]))
            if len(scores) > k:
                floor = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                docs, scores = docs[scores >= floor], scores[scores >= floor]
            done, step = done + step, step * 2
        return docs, scores


def search(index: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text", short: float = 1 / 16) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query, by score and then by ascending id; scores above 0 only.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document's m is 75 + (25 n N) div L; its score sums
    weight x ((10^9 tf) div (1000 tf + 12 m)) over the query's terms, repeats included. N counts documents with a term, L
    their terms, n one document's. ``short`` is the part of a block's documents up to which a list counts as short: it
    decides speed only. Equal rows of queries are one query; different texts of one id are one query each. Null or
    term-less queries, or an empty index, give no rows. Documents of one id are ranked each for itself; null ids last.
    Queries go to the tasks in groups that fit a broadcast, a pass over the index for each group.
    """
    spark = index.sparkSession
    documents, total = index.select(F.sum(F.size("lengths").cast("long")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    documents, total = documents or 0, total or 0
    asked = stage(queries.select(F.col(id_col).alias("item_id"), utf8(text_col).alias("text")).distinct().withColumn("query", F.xxhash64("item_id", "text")), "queries")
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    groups = max(1, -(-4 * size // BROADCAST_BYTES))
    df = stage(index.select("terms", "edges").mapInArrow(_frequencies, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")), "frequencies")
    id_type = index.schema["ids"].dataType.elementType
    out = T.StructType([T.StructField("query", T.LongType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    found = None
    for g in range(groups):
        mine = asked.filter(F.pmod("query", F.lit(groups)) == g)
        bags = {r["query"]: Counter(terms(r["text"])) for r in mine.collect()}
        wanted = spark.createDataFrame([(t,) for t in {t for b in bags.values() for t in b}], "term binary")
        weight = {bytes(r["term"]): r["w"] for r in df.join(F.broadcast(wanted), "term").select("term", F.floor(1000 * F.ln((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1))).alias("w")).collect()}
        shared = spark.sparkContext.broadcast({q: [(t, n * weight[t]) for t, n in bag.items() if t in weight] for q, bag in bags.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[list, list[int]]] = {}  # ids and scores, the best k with ties of the task so far
            floors: dict[int, int] = {}
            kind = None
            for batch in batches:
                for row in range(batch.num_rows):
                    block = Block(batch, row, documents, total)
                    kind = block.ids.type
                    for q, weights in shared.value.items():
                        docs, scores = block.best(weights, k, floors.get(q, 1), short)
                        if not len(docs):
                            continue
                        ids, old = best.get(q, ([], []))
                        rows = sorted(zip([*old, *scores.tolist()], [*ids, *block.ids.take(pa.array(docs)).to_pylist()], strict=True), key=lambda r: (-r[0], r[1] is None, r[1]))[:k]
                        best[q] = ([i for _, i in rows], [s for s, _ in rows])
                        if len(rows) == k:
                            floors[q] = rows[-1][0]
            flat = [(q, i, s) for q, (ids, scores) in best.items() for i, s in zip(ids, scores, strict=True)]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.int64()), pa.array([r[1] for r in flat], kind), pa.array([r[2] for r in flat], pa.int64())], ["query", "doc_id", "score"])

        part = index.mapInArrow(run, out)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
