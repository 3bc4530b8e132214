"""Quality by histogram gradient-boosted trees over document statistics.

Statistics are cut into at most 64 bins by quantiles of the sample; each tree level is grown for all its nodes at once from
histograms of gradients. Finished trees are flattened into arrays (feature, bin, value; children of node i at 2i+1 and
2i+2), so that numpy walks a whole batch of documents through a tree level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import in_fold, utf8

NAMES = (
    "bytes", "words", "lines", "bytes_per_word", "words_per_line", "upper", "lower", "digit", "space", "not_ascii",
    "sentence_marks", "symbols", "bars", "distinct_words", "distinct_lines", "most_frequent_word", "longest_word", "ended_lines",
    "distinct_bytes", "short_words",
)
_CLASSES = np.zeros((256, 8))
for _k, _of in enumerate((range(65, 91), range(97, 123), range(48, 58), (9, 10, 11, 12, 13, 32), range(128, 256), b".,;:!?", b"#$%&*+/<=>@[\\]^_`{}~", b"|")):
    _CLASSES[list(_of), _k] = 1


@dataclass(frozen=True)
class Settings:
    """trees, depth, rate (shrinkage), bins, l2 (on leaf values), least (sum of second derivatives a leaf needs); sample: how
    many labelled documents are learnt from at most (those of smallest id hash)."""

    trees: int = 60
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    l2: float = 1.0
    least: float = 2.0
    sample: int = 12_000


def statistics(text: str) -> list[float]:
    """The document's statistics, in the order of NAMES; the whole text counts."""
    raw = text.encode("utf-8", "surrogatepass")
    size = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = (counts @ _CLASSES) / size
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    distinct = dict.fromkeys(words)
    lengths = list(map(len, words))
    some = {w: 0 for w in distinct}
    for w in words:
        some[w] += 1
    ended = sum(1 for x in lines if x[-1:] in ".!?")
    return [
        len(raw), len(words), len(lines), len(raw) / n, n / len(lines), *share.tolist(),
        len(distinct) / n, len(set(lines)) / len(lines), max(some.values(), default=0) / n, max(lengths, default=0), ended / len(lines),
        float(np.count_nonzero(counts)), sum(1 for x in lengths if x <= 3) / n,
    ]


@dataclass
class Model:
    """cuts: for each statistic the upper bounds of its bins. feature, at, value: a row a tree. feature is -1 at leaves."""

    cuts: list[np.ndarray]
    feature: np.ndarray
    at: np.ndarray
    value: np.ndarray
    start: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(self.cuts)]) if len(x) else np.zeros((0, len(self.cuts)), int)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out, row = np.full(len(x), self.start), np.arange(len(x))
        depth = (self.feature.shape[1] + 1).bit_length() - 2 if len(self.feature) else 0
        for feature, at, value in zip(self.feature, self.at, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                f = feature[node]
                right = b[row, np.maximum(f, 0)] > at[node]
                node = np.where(f < 0, node, 2 * node + 1 + right)
            out += value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Model:
    """Boosted trees for log-loss. Without examples the score is 0.5 everywhere."""
    s, n_features = settings, len(NAMES)
    nodes = 2 ** (s.depth + 1) - 1
    if not len(y):
        return Model([np.zeros(0)] * n_features, np.zeros((0, nodes), np.int32), np.zeros((0, nodes), np.int32), np.zeros((0, nodes)), 0.0)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, s.bins + 1)[1:-1])) for k in range(n_features)]
    p = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(p / (1 - p)))
    model = Model(cuts, np.zeros((0, nodes), np.int32), np.zeros((0, nodes), np.int32), np.zeros((0, nodes)), start)
    b = model.binned(x)
    width = s.bins + 1
    cell = b + np.arange(n_features) * width  # a histogram's cell for each statistic
    f_all, at_all, v_all, raw = [], [], [], np.full(len(y), start)
    for _ in range(s.trees):
        prob = 1 / (1 + np.exp(-raw))
        g, h = prob - y, prob * (1 - prob)
        feature, at, value = np.full(nodes, -1, np.int32), np.zeros(nodes, np.int32), np.zeros(nodes)
        node = np.zeros(len(y), np.int64)
        for level in range(s.depth + 1):
            first, many = 2**level - 1, 2**level
            here = node >= first
            local = node[here] - first
            key = (local[:, None] * (n_features * width) + cell[here]).ravel()
            size = many * n_features * width
            hg = np.bincount(key, np.repeat(g[here], n_features), size).reshape(many, n_features, width)
            hh = np.bincount(key, np.repeat(h[here], n_features), size).reshape(many, n_features, width)
            tg, th = hg[:, 0].sum(1), hh[:, 0].sum(1)
            value[first : first + many] = np.where(th > 0, -s.rate * tg / (th + s.l2), 0)
            if level == s.depth:
                break
            lg, lh = hg.cumsum(2), hh.cumsum(2)
            rg, rh = tg[:, None, None] - lg, th[:, None, None] - lh
            gain = lg**2 / (lh + s.l2) + rg**2 / (rh + s.l2) - (tg**2 / (th + s.l2))[:, None, None]
            gain[(lh < s.least) | (rh < s.least)] = 0
            best = gain.reshape(many, -1).argmax(1)
            good = gain.reshape(many, -1)[np.arange(many), best] > 1e-6
            feature[first : first + many] = np.where(good, best // width, -1)
            at[first : first + many] = best % width
            f = feature[node]
            right = b[np.arange(len(y)), np.maximum(f, 0)] > at[node]
            node = np.where(here & (f >= 0), 2 * node + 1 + right, node)
        raw = raw + value[node]
        f_all.append(feature)
        at_all.append(at)
        v_all.append(value)
    return Model(cuts, np.array(f_all), np.array(at_all), np.array(v_all), start)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from at most ``settings.sample`` labelled documents outside the held-out fold: those whose id hashes lowest.

    Only their statistics (a row of 20 numbers each) reach the driver. Null labels, labels that contradict each
    other for one id, and those without a document teach nothing; of documents that repeat an id the smallest text teaches.
    """
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("l_id").isNotNull() & F.col("label").isNotNull())
    known = known.filter(~in_fold("l_id")).groupBy("l_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    known = known.orderBy(F.xxhash64("l_id"), "l_id").limit(settings.sample)
    some = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("l_id"))
    some = some.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["id", "label", "x"])

    found = some.select(F.xxhash64("doc_id", "text").alias("id"), "label", "text").mapInArrow(measure, "id long, label int, x array<double>").toArrow()
    order = np.argsort(np.asarray(found["id"]), kind="stable")
    x = np.array(found["x"].to_pylist(), float).reshape(-1, len(NAMES))[order]
    return fit(x, np.asarray(found["label"], float)[order], settings)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    Null texts count as empty; repeated rows give a row each; other columns are ignored; texts may be of any length; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column(1).to_pylist()], float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(x), pa.float64())], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", in_fold("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
