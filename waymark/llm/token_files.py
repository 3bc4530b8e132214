"""Token ids of documents in Arrow files of equal-length sequences, for training jobs that map them into memory.

Documents are dealt out by ranges of their ids. A task encodes its range in order, ends each document with ``end_id``, cuts
the stream into sequences of ``length`` ids and writes them batch by batch: nothing of a task is held but one batch. A file's
rows are

* ``tokens``: fixed-size list of unsigned 16-bit ids (32-bit where the vocabulary needs them), the last sequence padded,
* ``mask``: fixed-size list of booleans, true for an id and false for padding,
* ``doc_ids``, ``doc_starts``: the documents that begin in the sequence and where.

Batches are uncompressed and hold ``BATCH`` sequences each, so sequence i of a mapped file is a view into the file's own
bytes. A task names each file anew and returns what it wrote; only files in that manifest count, so a task that runs again
after a lost executor does no harm, and what the first attempt left is never read.
"""

from __future__ import annotations

import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import scratch, stage, utf8
from waymark.llm.token_counts import PIECES, Characters, _tokenizer

#: Sequences of a record batch.
BATCH = 512
#: White space as the pre-tokenizer deals it out: a word with the space before it never shares a pre-token with its neighbours.
WORDS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
LONGEST = 64


class Recent(dict):
    """A cache in two generations: what ``make`` gives for a key is kept until ``most`` newer keys, at least, have come."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in the vocabulary: printable Latin-1 characters for themselves, code points from 256 on for the rest, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of a text as bytes, by words: this Python worker keeps what it has met, in two generations of ``most`` words.

    Words it lacks are cut into pre-tokens, and those that it lacks too go to the tokenizer's model. Texts with special
    strings, or with characters on which the patterns here and the tokenizer's could differ, go to the tokenizer whole.
    """

    def __init__(self, json: str, most: int):
        self.tokenizer = _tokenizer(json)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype(f"<u{array(self.code).itemsize}")
        self.characters, self.letters = Characters(self.tokenizer), _byte_letters()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find, self.model = re.compile(PIECES).findall, self.tokenizer.model
        self.pieces = Recent(self._piece, most)
        self.words = Recent(lambda word: b"".join(map(self.pieces.__getitem__, self.find(word))), most)

    def _bytes(self, ids: list[int]) -> bytes:
        made = array(self.code, ids)
        if sys.byteorder == "big":
            made.byteswap()
        return made.tobytes()

    def _piece(self, text: str) -> bytes:
        return self._bytes([t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.letters))])

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.specials) or not self.characters.plain(text):
            return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.words.__getitem__, WORDS.findall(text)))


#: The encoder of this Python worker, by its tokenizer: workers serve many tasks, and each would begin with an empty cache.
_encoders: dict[str, Encoder] = {}


def _encoder(json: str, most: int) -> Encoder:
    if json not in _encoders:
        _encoders.clear()
        _encoders[json] = Encoder(json, most)
    return _encoders[json]


def _schema(id_type: pa.DataType, kind: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length)), ("doc_ids", pa.list_(id_type)), ("doc_starts", pa.list_(pa.int32()))])


class Writer:
    """One file: documents in, record batches out."""

    def __init__(self, folder: str, id_type: pa.DataType, kind: np.dtype, length: int):
        self.system, path = fs.FileSystem.from_uri(folder)
        self.system.create_dir(path, recursive=True)
        name = f"tokens-{uuid.uuid4().hex}.arrow"
        self.file, self.length, self.kind, self.id_type = f"{folder.rstrip('/')}/{name}", length, kind, id_type
        self.out = self.system.open_output_stream(f"{path.rstrip('/')}/{name}")
        self.schema = _schema(id_type, kind, length)
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.held, self.cut, self.sequences, self.documents = bytearray(), 0, 0, 0
        self.ids: list = []
        self.starts: list[int] = []

    @property
    def tokens(self) -> int:
        return self.cut + len(self.held) // self.kind.itemsize

    def add(self, doc_id, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.starts.append(self.tokens)
        self.documents += 1
        self.held += ids
        while len(self.held) >= BATCH * self.length * self.kind.itemsize:
            self._flush(BATCH)

    def _flush(self, n: int) -> None:
        whole, width = n * self.length, self.kind.itemsize
        part = bytes(self.held[: whole * width])
        del self.held[: whole * width]
        real = len(part) // width
        tokens = np.frombuffer(part.ljust(whole * width, b"\0"), self.kind)
        here = int(np.searchsorted(self.starts, self.cut + real)) if self.starts else 0
        at = np.array(self.starts[:here], np.int64) - self.cut
        edges = pa.array(np.searchsorted(at, np.arange(n + 1) * self.length), pa.int32())
        fixed = lambda values: pa.FixedSizeListArray.from_arrays(values, self.length)
        columns = [fixed(pa.array(tokens)), fixed(pa.array(np.arange(whole) < real)), pa.ListArray.from_arrays(edges, pa.array(self.ids[:here], self.id_type)), pa.ListArray.from_arrays(edges, pa.array(at % self.length, pa.int32()))]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        del self.ids[:here], self.starts[:here]
        self.cut += real
        self.sequences += n

    def close(self) -> None:
        if rest := -(-len(self.held) // (self.length * self.kind.itemsize)):
            self._flush(rest)
        self.writer.close()
        self.out.close()


def write(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, length: int = 2048, file_tokens: int = 1 << 28, cache: int = 1 << 19) -> DataFrame:
    """Write the ids of all texts in ascending order of document ids, and return the manifest.

    The manifest has a row a file: file, base (ids in all files before it), tokens, sequences, documents. ``folder`` is a URI
    that pyarrow's file systems open on every executor; by default a new one below spark.checkpoint.dir. A file ends after
    the document that reaches ``file_tokens``.

    A null text is empty and gives the end id alone. Rows of one id stay side by side, ordered by their texts' hashes; null
    ids come first. A text of any length is encoded whole. No documents: no files, an empty manifest. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    folder = folder or scratch(spark, "token-files")
    slim = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text")).select("doc_id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"), "text")
    order = [F.asc_nulls_first("doc_id"), F.asc("hash"), F.asc("place")]
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, cache)
        end = np.array([end_id], encoder.kind).tobytes()
        file, first, done = None, None, []
        id_type = pa.int64()
        for batch in batches:
            ids, hashes, places, texts = (c.to_pylist() for c in batch.columns)
            id_type = batch.column(0).type
            for doc_id, h, p, text in zip(ids, hashes, places, texts, strict=True):
                if file is None:
                    file, first = Writer(folder, id_type, encoder.kind, length), (doc_id, h, p)
                file.add(doc_id, encoder.ids(text) + end)
                if file.tokens >= file_tokens:
                    file.close()
                    done.append((file, *first))
                    file = None
        if file:
            file.close()
            done.append((file, *first))
        names = ["file", "tokens", "sequences", "documents", "doc_id", "hash", "place"]
        values = [(w.file, w.tokens, w.sequences, w.documents, *key) for w, *key in done]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), id_type, pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in values], t) for i, t in enumerate(kinds)], names)

    written = stage(slim.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"file string, tokens long, sequences long, documents long, doc_id {kind}, hash long, place long"), "token-manifest")
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return stage(written.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"), "tokens", "sequences", "documents", F.lit(kind).alias("id_type")), "token-bases")


class TokenFile:
    """A written file, mapped into memory where its file system is local: sequences, masks and documents by number."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("tokens").type.list_size

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray, list, np.ndarray]]:
        """For each batch: its ids without padding, as one view; its mask; ids and places of the documents that begin in it."""
        for i in range(self.reader.num_record_batches):
            b = self.reader.get_batch(i)
            mask = b.column(1).flatten().to_numpy(zero_copy_only=False)
            counts = b.column(3).value_lengths().to_numpy()
            at = b.column(3).flatten().to_numpy() + np.repeat(np.arange(len(counts), dtype=np.int64) * self.length, counts)
            yield b.column(0).flatten().to_numpy()[: int(mask.sum())], mask, b.column(2).flatten().to_pylist(), at

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i; the ids are a view into the file."""
        b = self.reader.get_batch(i // BATCH)
        cut = slice(i % BATCH * self.length, (i % BATCH + 1) * self.length)
        return b.column(0).flatten().to_numpy()[cut], b.column(1).flatten()[cut.start : cut.stop].to_numpy(zero_copy_only=False)

    def documents(self) -> Iterator[tuple[object, int, int, int]]:
        """(id, start in this file, ids, crc32 of the ids as little-endian 32-bit integers) of each document."""
        begun, seen = None, 0
        for tokens, _, ids, at in self.batches():
            edges = [*at.tolist(), len(tokens)]
            if begun and edges[0]:
                begun = (*begun[:2], begun[2] + edges[0], zlib.crc32(tokens[: edges[0]].astype("<u4"), begun[3]))
            for doc_id, a, b in zip(ids, edges, edges[1:], strict=False):
                if begun:
                    yield begun
                begun = (doc_id, seen + a, b - a, zlib.crc32(tokens[a:b].astype("<u4")))
            seen += len(tokens)
        if begun:
            yield begun


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, read from the files."""
    spark = manifest.sparkSession
    kind = (manifest.select("id_type").first() or ["long"])[0]
    files = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base, id_type in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                f, rows = TokenFile(file), []
                id_type = f.reader.schema.field("doc_ids").type.value_type
                make = lambda rows, t=id_type: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((t, pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "start", "n_tokens", "ids_crc32"])
                for doc_id, start, n, crc in f.documents():
                    rows.append((doc_id, base + start, n, crc))
                    if len(rows) == 10_000:
                        yield make(rows)
                        rows = []
                if rows:
                    yield make(rows)

    spread = max(1, min(files, 4 * spark.sparkContext.defaultParallelism))
    return manifest.select("file", "base", "id_type").repartition(spread).mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
