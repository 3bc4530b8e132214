"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Learning sees labelled documents one by one. Each coordinate has its own learning rate, which falls with the gradients it
has met, and an L1 penalty that keeps it at exactly zero until the evidence outweighs it; what is left is a short list of
weights, which is broadcast for scoring. A feature counts once a document, however often it occurs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import in_fold, utf8

WORDS = re.compile(r"[^\W_]+")
#: Latin-1 bytes in lower case, and a space for those outside words: cuts a text as WORDS does, without a match a word.
LATIN = bytes(ord(c.lower()) if WORDS.match(c) else 32 for c in map(chr, range(256)))
#: Longer words are hashed each time, so that the cache of word hashes stays small.
LONGEST, CACHE = 40, 1 << 19
#: Odd multipliers of the places in an n-gram (first, second, third; and second of a skip-gram).
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@dataclass(frozen=True)
class Settings:
    """bits: size of the hashed space; alpha, beta, l1, l2: FTRL-proximal's; passes over the sample; sample: how many labelled
    documents are learnt from at most (those of smallest id hash); ngram and skip: longest n-gram, and widest gap of a pair."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.1
    passes: int = 5
    sample: int = 12_000
    ngram: int = 2
    skip: int = 2
    seed: int = 7


def words_of(text: str) -> list[str] | list[bytes]:
    """The words of a text in lower case, as Latin-1 bytes if it has no other characters."""
    try:
        return text.encode("latin-1").translate(LATIN).split()
    except UnicodeEncodeError:
        return WORDS.findall(text.lower())


class WordHashes(dict):
    """Word to 64-bit hash, the same on every machine, for text and Latin-1 bytes alike; a cache of bounded size."""

    def __missing__(self, w: str | bytes) -> int:
        from xxhash import xxh64_intdigest

        h = xxh64_intdigest(w.decode("latin-1") if isinstance(w, bytes) else w, 7)
        if len(w) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[w] = h
        return h


class Hasher:
    """Feature numbers of a text, repeats included."""

    def __init__(self, settings: Settings):
        self.settings, self.hash = settings, WordHashes().__getitem__

    def __call__(self, text: str) -> np.ndarray:
        ws = words_of(text)
        h = np.fromiter(map(self.hash, ws), np.uint64, len(ws))
        n_max, skip, n = self.settings.ngram, self.settings.skip, len(h)
        first = h * PLACES[0]
        parts = [first]
        for k in range(2, n_max + 1):
            if n >= k:
                parts.append(sum((h[j : n - k + 1 + j] * PLACES[j] for j in range(1, k)), first[: n - k + 1] + np.uint64(k)))
        if skip:
            second = h * PLACES[3]
        for gap in range(1, skip + 1):
            if n > gap + 1:
                parts.append(first[: -gap - 1] + second[gap + 1 :] + np.uint64(gap))
        every = np.concatenate(parts)
        every ^= every >> np.uint64(32)
        every >>= np.uint64(3)
        every &= np.uint64((1 << self.settings.bits) - 1)
        return every.view(np.int64)


@dataclass
class Model:
    """Non-zero weights by feature number, and the bias."""

    settings: Settings
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.settings.bits, np.float32)
        w[self.index] = self.weight
        return w


class Scorer:
    """A text's score by a model."""

    def __init__(self, model: Model):
        self.bias, self.weight, self.hasher = model.bias, model.dense(), Hasher(model.settings)
        self.used = self.weight != 0

    def __call__(self, text: str) -> float:
        i = self.hasher(text)
        i = np.unique(i[self.used[i]])
        return float(sigmoid(self.bias + float(self.weight[i].sum(dtype=np.float64))))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(features: list[np.ndarray], labels: list[int], settings: Settings) -> Model:
    """FTRL-proximal over distinct features; the order of examples is drawn anew each pass, from a fixed seed."""
    s = settings
    size = (1 << s.bits) + 1  # the last coordinate is the bias, without a penalty
    z, n = np.zeros(size), np.zeros(size)
    l1 = np.full(size, s.l1)
    l1[-1] = 0
    rng = np.random.default_rng(s.seed)
    examples = [np.append(f, size - 1) for f in features]

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1[i], 0, (np.sign(zi) * l1[i] - zi) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2))

    for _ in range(s.passes):
        for k in rng.permutation(len(examples)):
            i = examples[k]
            w = weights(i)
            g = float(sigmoid(w.sum())) - labels[k]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(size))
    index = np.flatnonzero(w[:-1])
    return Model(s, index.astype(np.int32), w[index].astype(np.float32), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from at most ``settings.sample`` labelled documents outside the held-out fold: those whose id hashes lowest.

    The sample's bound makes its ids broadcastable, its features fit one task, and the work of learning independent of the
    corpus. Labels that are null, that contradict each other for one id, or whose document is missing teach nothing; of
    documents that repeat an id the smallest text teaches. Without any label the score is 0.5 everywhere.
    """
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("l_id").isNotNull() & F.col("label").isNotNull())
    known = known.filter(~in_fold("l_id")).groupBy("l_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    known = known.orderBy(F.xxhash64("l_id"), "l_id").limit(settings.sample)
    some = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("l_id"))
    some = some.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(settings)
        for b in batches:
            f = [np.unique(hasher(t)).astype(np.int32) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f, pa.list_(pa.int32()))], ["id", "label", "features"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ys, fs = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            ys += b.column(1).to_pylist()
            fs += [np.asarray(x.values) for x in b.column(2)]
        order = np.argsort(ids, kind="stable")
        m = fit([fs[k] for k in order], [ys[k] for k in order], settings) if ids else Model(settings, np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([*m.index.tolist(), -1], pa.int32()), pa.array([*m.weight.tolist(), m.bias], pa.float64())], ["i", "w"])

    features = some.select(F.xxhash64("doc_id", "text").alias("id"), "label", "text").mapInArrow(hashed, "id long, label int, features array<int>")
    found = features.repartition(1).mapInArrow(learn, "i int, w double").toPandas()
    w = found[found.i >= 0]
    return Model(settings, w.i.to_numpy(np.int32), w.w.to_numpy(np.float32), float(found[found.i < 0].w.iloc[0]))


def score(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    Null texts count as empty and get the bias's score. Repeated rows give a row each; other columns are ignored; texts may be
    of any length; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            out = [scorer(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", in_fold("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below ``threshold``, with all their columns. A null text counts as empty.

    A model without weights has learnt nothing that tells documents apart, as without usable labels: all rows stay.
    """
    if not len(model.index):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            yield b.filter(pa.array([scorer(t or "") < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
