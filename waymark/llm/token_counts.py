"""Token counts of whole texts by a byte-level BPE tokenizer, without a shuffle of pre-tokens.

A text's token count is the sum of the lengths of its pre-tokens, each encoded alone. Two tiers answer for a length:

1. a compact table of the corpus's frequent pre-tokens, encoded once and broadcast (at most ``table_size`` entries);
2. a bounded cache in each Python worker for the rest; what it lacks goes to the tokenizer itself.

The frequent pre-tokens come from one pass over all texts in which each task counts words in a bounded summary; only
the summaries meet. They decide speed, never a count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import rows, utf8

#: The byte-level pre-tokenizer's pattern in the syntax of ``re``. Characters on which the two engines
#: differ are found by ``Characters`` and their texts go to the tokenizer whole.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Longer pre-tokens are encoded each time, so that a cache entry stays small.
LONGEST = 64


def _tokenizer(json: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(json)


class Characters:
    """Which characters this module's pattern and the tokenizer put in the same class; each is tried once."""

    def __init__(self, tokenizer):
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.find = re.compile(PIECES).findall
        self.seen: set[str] = set()
        self.odd: set[str] = set()

    def plain(self, text: str) -> bool:
        here = set(text)
        for c in here - self.seen:
            for probe in (f"a{c}a", f"1{c}1", f"!{c}!", f" {c} {c}b"):
                if [e - s for _, (s, e) in self.split(probe)] != [len(x) for x in self.find(probe)]:
                    self.odd.add(c)
                    break
            self.seen.add(c)
        return not self.odd or self.odd.isdisjoint(here)


class Lengths(dict):
    """Pre-token to number of tokens: the broadcast table, and what this worker has met since, up to ``most`` entries."""

    def __init__(self, tokenizer, table: dict[str, int], most: int):
        super().__init__(table)
        self.tokenizer, self.table, self.most = tokenizer, table, most

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST:
            if len(self) >= self.most + len(self.table):
                self.clear()
                self.update(self.table)
            self[piece] = n
        return n


def _frequent_words(batches, keep: int) -> Iterator[pa.RecordBatch]:
    """Each task's most frequent white-space words. The counter is cut back to ``keep`` whenever it holds eight times that."""
    found: Counter[str] = Counter()
    for (texts,) in rows(batches, "text"):
        for text in texts:
            found.update(text.split(" "))
        if len(found) > 8 * keep:
            found = Counter(dict(found.most_common(keep)))
    top = [(w, n) for w, n in found.most_common(keep) if 0 < len(w) < LONGEST]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])


def frequent_lengths(docs: DataFrame, tokenizer_json: str, text_col: str = "text", table_size: int = 1 << 15, per_task: int = 1 << 13) -> dict[str, int]:
    """Token counts of the corpus's most frequent pre-tokens, at most ``table_size`` of them.

    All texts are read; a task sends on at most ``per_task`` words with their counts.
    """
    words = (
        docs.select(utf8(text_col).alias("text"))
        .mapInArrow(lambda it: _frequent_words(it, per_task), "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(table_size)
        .collect()
    )
    find, n = re.compile(PIECES).findall, Counter()
    for r in words:
        for piece in find(f" {r['word']}"):
            n[piece] += r["n"]
    pieces = [p for p, _ in n.most_common(table_size) if len(p) <= LONGEST]
    tokenizer = _tokenizer(tokenizer_json)
    return {p: len(e.ids) for p, e in zip(pieces, tokenizer.encode_batch(pieces, add_special_tokens=False), strict=True)}


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, table_size: int = 1 << 15, cache_size: int = 1 << 18) -> DataFrame:
    """One row a document: its id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts equal ``Tokenizer.encode(text, add_special_tokens=False)``, with the tokenizer's default treatment of special
    strings inside a text. A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and ids give a row each; null ids
    stay null; other columns of docs are ignored. The tokenizer file must be a byte-level BPE in the ``tokenizers`` format;
    it is read once on the driver and broadcast.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        json = f.read()
    shared = spark.sparkContext.broadcast((json, frequent_lengths(docs, json, text_col, table_size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared.value[0])
        lengths = Lengths(tokenizer, shared.value[1], cache_size)
        characters, find, length = Characters(tokenizer), re.compile(PIECES).findall, lengths.__getitem__
        specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            tokens = []
            for text in texts:
                if any(s in text for s in specials) or not characters.plain(text):
                    tokens.append(len(tokenizer.encode(text, add_special_tokens=False).ids))
                else:
                    tokens.append(sum(map(length, find(text))))
            n = pa.array(tokens, pa.int64())
            size = pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, size, n, pa.array([x > limit for x in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
