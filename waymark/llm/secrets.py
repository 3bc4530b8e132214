"""Secret scan of whole texts and of what is encoded inside them.

A worklist holds layers: the text itself, then every text that comes out of undoing an encoding in a layer already
scanned (URL escapes, Unicode escapes, base64 on one line or several, and compressed bytes inside base64 or escapes). Each new layer is scanned by the same
patterns and searched for further encodings, until nothing new comes out. A layer whose text came out of the same characters
of the document before isn't followed again, so encodings that lead back to themselves end; the same text in another place is
a layer of its own, and its findings count. Every character of a layer knows which characters of the document it came from;
findings are reported there.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Generator, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import utf8

#: The kinds in order, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the longest run from AKIA on, 20 characters or more
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # whole runs, 24 characters or more

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})+")
#: Escapes of other languages: \\UXXXXXXXX, %uXXXX and three octal digits.
MORE = re.compile(r"(?:\\U[0-9A-Fa-f]{8}|%u[0-9A-Fa-f]{4}|\\[0-3][0-7]{2})+")
ENTITY = re.compile(r"(?:&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines.
LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)+={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: Compressed bytes as escapes: where they may begin, and their characters from there on.
PACKED_URL = re.compile(r"%1[fF]%8[bB]|(?:x|%78)(?:%01|%5[eE]|\^|%9[cC]|%[dD][aA])|(?:B|%42)(?:Z|%5[aA])(?:h|%68)(?:[1-9]|%3[1-9])(?:1|%31)(?:A|%41)|%[fF][dD](?:7|%37)(?:z|%7[aA])")
PACKED_X = re.compile(
    r"\\x1[fF]\\x8[bB]|\\u001[fF]\\u008[bB]|(?:x|\\x78|\\u0078)(?:\\x01|\^|\\x5[eE]|\\x9[cC]|\\x[dD][aA]|\\u0001|\\u005[eE]|\\u009[cC]|\\u00[dD][aA])"
    r"|(?:B|\\x42|\\u0042)(?:Z|\\x5[aA]|\\u005[aA])(?:h|\\x68|\\u0068)(?:[1-9]|\\x3[1-9]|\\u003[1-9])(?:1|\\x31|\\u0031)(?:A|\\x41|\\u0041)|(?:\\x|\\u00)[fF][dD](?:7|\\x37|\\u0037)(?:z|\\x7[aA]|\\u007[aA])"
)
BYTE_URL = re.compile(r"%([0-9A-Fa-f]{2})|([\x00-\xff])")
BYTE_X = re.compile(r"\\(?:x|u00)([0-9A-Fa-f]{2})|\\([abfnrtv0\\'\"])|([\x00-\xff])")
SHORT = dict(zip("abfnrtv0\\'\"", b"\a\b\f\n\r\t\v\0\\'\"", strict=True))
#: Decompressed bytes are scanned in windows of so many, which overlap; a window grows to LAYER_BYTES at most, and only while
#: an encoded run is open at its end. This guards a worker's memory, not the length of what is read.
PIECE_BYTES, WINDOW_BYTES, OVERLAP_BYTES, LAYER_BYTES = 1 << 20, 8 << 20, 1 << 16, 64 << 20
OPEN_RUN = re.compile(rb"\A[A-Za-z0-9+/_=%\\{}&#;\r\n-]*+")


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns in one text: leftmost, non-overlapping per kind; end is exclusive."""
    out = []
    low = text.lower()
    if (":" in text or "=" in text) and any(w in low for w in ("passw", "secret", "token", "api")):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def _text(raw: bytes) -> str:
    """Bytes as text, whatever they hold: UTF-8, else a character a byte.

    All patterns and encodings are ASCII, so either reading shows them.
    """
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _decompressor(head: bytes):
    """What undoes the compression that these first bytes declare (gzip, zlib, bzip2, xz), else None."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2], "big") % 31 == 0:
        return zlib.decompressobj(15)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _inflated(chunks: Iterable[bytes], rest: list[int | None] | None = None) -> Iterator[bytes]:
    """What compressed bytes hold, in pieces: member after member, up to their end or to the first damage.

    ``rest`` gets the number of bytes that were read from the chunks and belong to no member; None if one is damaged.
    """
    chunks, data, whole = iter(chunks), b"", True
    while True:
        data = data.lstrip(b"\0")  # padding between members
        while len(data) < 6 and (more := next(chunks, None)) is not None:
            data = (data + more).lstrip(b"\0")
        if (d := _decompressor(data)) is None:
            break
        try:
            while not d.eof:
                piece = d.decompress(data, PIECE_BYTES)
                data = getattr(d, "unconsumed_tail", b"")
                if piece:
                    yield piece
                elif not d.eof and not data and (data := next(chunks, b"")) == b"":
                    break
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            whole = False
            break
        if not d.eof:
            whole = False
            break
        data = d.unused_data
    if rest is not None:
        rest.append(len(data) if whole else None)


def _inflated_raw(raw: bytes) -> Iterator[bytes]:
    """What deflated bytes without a header hold, in pieces."""
    d, data = zlib.decompressobj(-15), raw
    while not d.eof:
        piece = d.decompress(data, PIECE_BYTES)
        data = d.unconsumed_tail
        if not piece and not data and not d.eof:
            raise zlib.error("the bytes end early")
        if piece:
            yield piece
    if d.unused_data:
        raise zlib.error("more bytes follow")


def _deflated(raw: bytes) -> bool:
    """Whether all the bytes are one deflate stream without a header, of at least 8 bytes."""
    if len(raw) < 8 or raw[0] >> 1 & 3 not in (1, 2):  # stored blocks show their text as they are
        return False
    try:
        return any([len(p) > 0 for p in _inflated_raw(raw)])
    except zlib.error:
        return False


def _windows(pieces: Iterable[bytes], digest) -> Iterator[bytes]:
    """The pieces end to end as windows that overlap; digest is fed each byte once.

    A window goes on while an encoded run is open at its end, so that runs up to LAYER_BYTES are never cut; a longer run is
    cut with the overlap.
    """
    held = bytearray()
    fresh = False
    for piece in pieces:
        digest.update(piece)
        held += piece
        fresh = True
        if len(held) < WINDOW_BYTES:
            continue
        whole = len(held) >= LAYER_BYTES
        tail = len(OPEN_RUN.search(held[::-1])[0])
        if tail >= len(held) - OVERLAP_BYTES and not whole:
            continue
        yield bytes(held)
        del held[: len(held) - (OVERLAP_BYTES if whole else max(tail, OVERLAP_BYTES))]
        fresh = False
    if fresh:
        yield bytes(held)


def _unpacked(raw: Callable[[], Iterable[bytes]], rest: list[int | None] | None = None) -> Iterator[bytes]:
    """Windows of what compressed bytes hold, and of what that holds if it is compressed itself, down to a cycle."""
    seen: set[bytes] = set()
    while True:
        outer = raw
        digest, some = hashlib.sha256(), False
        for window in _windows(_inflated(outer(), rest), digest):
            some = True
            yield window
        raw, rest = (lambda outer=outer: _inflated(outer())), None
        if not some or digest.digest() in seen:
            return
        seen.add(digest.digest())


def _run(escape: str, whole: str) -> tuple[list[str], list[int]] | None:
    """The characters of a run of escapes, and where in the run each begins."""
    if escape == "url":
        raw = bytes(int(whole[i + 1 : i + 3], 16) for i in range(0, len(whole), 3))
        chars, at, i = [], [], 0
        while i < len(raw):
            n = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
            c = raw[i : i + n].decode("utf-8", "replace")
            if len(c) != 1 or c == "\ufffd":
                c, n = chr(raw[i]), 1
            chars.append(c)
            at.append(3 * i)
            i += n
        return chars, at
    chars, at = [], []
    for m in re.finditer(r"\\u\{([0-9A-Fa-f]+)\}|(?:\\[uUx]|%u)([0-9A-Fa-f]+)|&#[xX]([0-9A-Fa-f]+);|&#([0-9]+);|\\([0-3][0-7]{2})", whole):
        code = int(m[4]) if m[4] else int(m[5], 8) if m[5] else int(m[1] or m[2] or m[3], 16)
        if code > 0x10FFFF:
            return None
        if at and 0xDC00 <= code < 0xE000 and 0xD800 <= ord(chars[-1]) < 0xDC00:  # the second half of a pair
            chars[-1] = chr(0x10000 + ((ord(chars[-1]) - 0xD800) << 10) + code - 0xDC00)
            continue
        chars.append(chr(code))
        at.append(m.start())
    return chars, at


class Layer:
    """A text and, for each of its characters, the first and last-plus-one character of the document it came from."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text, self.start, self.end, self.window = text, start, end, False

    def origin(self, s: int, e: int) -> tuple[int, int]:
        return (s, e) if self.start is None else (int(self.start[s:e].min()), int(self.end[s:e].max()))

    def mark(self) -> bytes:
        """The layer's identity: its text, and where each of its characters came from."""
        found = hashlib.sha256(self.text.encode("utf-8", "surrogatepass"))
        for at in (self.start, self.end):
            if at is not None and len(at):
                found.update(b"\0" + (at[:1] if at.strides == (0,) else np.ascontiguousarray(at)).tobytes())
        return found.digest()

    def _part(self, s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
        return (np.arange(s, e), np.arange(s + 1, e + 1)) if self.start is None else (self.start[s:e], self.end[s:e])

    def unescape(self, escape: str, pattern: re.Pattern) -> Layer | None:
        """This layer with all escapes of one sort undone."""
        parts, starts, ends, last = [], [], [], 0
        for m in pattern.finditer(self.text):
            if (run := _run(escape, m[0])) is None:
                continue
            chars, at = run
            bounds = [*at, len(m[0])]
            for s, e in ((last, m.start()),):
                a, b = self._part(s, e)
                parts.append(self.text[s:e])
                starts.append(a)
                ends.append(b)
            spans = [self.origin(m.start() + x, m.start() + y) for x, y in zip(bounds, bounds[1:], strict=False)]
            parts.append("".join(chars))
            starts.append(np.array([x for x, _ in spans]))
            ends.append(np.array([y for _, y in spans]))
            last = m.end()
        if not parts:
            return None
        a, b = self._part(last, len(self.text))
        parts.append(self.text[last:])
        return Layer("".join(parts), np.concatenate([*starts, a]), np.concatenate([*ends, b]))

    def unpack(self) -> Iterator[Layer]:
        """A layer for each base64 run: what it holds, and what that holds if it is compressed."""
        done: set[tuple[int, int]] = set()
        if "\n" in self.text:
            yield from self._unwrap(done)
        for m in BASE64.finditer(self.text):
            place = (m.start(), m.start() + len(m[0].rstrip("=")))
            if place not in done:
                whole = yield from self._decode([place])
                if not whole:
                    yield from self._glued(*place)

    def _glued(self, start: int, end: int) -> Iterator[Layer]:
        """Base64 glued to a path or a name by ``/``, ``_`` or ``-``, which its alphabet has too.

        What begins a multiple of four characters later is part of the same bytes, so at most three more readings show all plain
        text; a part that begins with compressed bytes is read for itself.
        """
        read = {0}
        for m in re.finditer("[/_-]", self.text[start:end]):
            at = start + m.end()
            if end - at < 16:
                break
            phase = (at - start) % 4
            head = base64.b64decode(self.text[at : at + 12].translate({45: 43, 95: 47}))
            if phase not in read or _decompressor(head) is not None:
                read.add(phase)
                size = end - at
                yield from self._decode([(at, end - (size % 4 == 1))])

    def _unwrap(self, done: set[tuple[int, int]]) -> Iterator[Layer]:
        """Lines of base64 as one run: all that follow each other, and those of one length with and without a shorter last.

        ``done`` gets the lines of compressed bytes that came out whole; nothing less is made of these.
        """
        for m in LINES.finditer(self.text):
            lines = [(m.start() + x.start(), m.start() + x.end()) for x in LINE.finditer(m[0])]
            width = [e - s for s, e in lines]
            tries, k = {(0, len(lines))}, 0
            while k < len(lines):
                n = next((i for i in range(k, len(lines)) if width[i] != width[k]), len(lines))
                tries.add((k, n))
                if n < len(lines) and width[n] < width[k]:
                    tries.add((k, n + 1))
                k = n
            for k, n in sorted(tries, key=lambda x: x[0] - x[1]):
                if n - k > 1 and lines[k] not in done and (yield from self._decode(lines[k:n])):
                    done.update(lines[k:n])

    def _decode(self, places: list[tuple[int, int]]) -> Generator[Layer, None, bool]:
        """The layer of one base64 run, which stands in one place or a line each in several, and what it holds compressed.

        Returns whether it is compressed and came out whole.
        """
        run = "".join(self.text[s:e] for s, e in places)
        body = run.translate({45: 43, 95: 47})
        if len(body) % 4 == 1:
            if len(places) == 1:
                return False
            body = run = body[:-1]
        try:
            raw = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
        except (binascii.Error, ValueError):
            return False
        rest: list[int | None] = []
        if _decompressor(raw) is not None:
            yield from self._packed(_unpacked(lambda: [raw], rest), places[0][0], places[-1][1])
        elif _deflated(raw):
            yield from self._packed(_windows(_inflated_raw(raw), hashlib.sha256()), places[0][0], places[-1][1])
        before = len(raw) - rest[0] if rest and rest[0] is not None else 0
        text = _text(raw[before:])
        whole = before > 0
        if not text:
            return whole
        plain = len(text) == len(raw) - before
        width = np.ones(len(text), np.int64) if plain else np.array([len(c.encode()) for c in text])
        last = before + np.cumsum(width)  # in bytes; byte k comes from base64 characters k*4//3 and on
        lo, hi = (last - width) * 4 // 3, (last * 4 + 2) // 3
        a, b = (np.concatenate(x) for x in zip(*(self._part(s, e) for s, e in places), strict=True))
        yield Layer(text, a[lo], b[np.minimum(hi, len(run)) - 1])
        return whole

    def _packed(self, windows: Iterator[bytes], s: int, e: int) -> Iterator[Layer]:
        """Layers of decompressed windows: each of their characters comes from all characters from s to e."""
        a, b = self.origin(s, e)
        for window in windows:
            text = _text(window)
            layer = Layer(text, np.broadcast_to(np.int64(a), len(text)), np.broadcast_to(np.int64(b), len(text)))
            layer.window = True
            yield layer

    def escaped(self, begin: re.Pattern, byte: re.Pattern) -> Iterator[Layer]:
        """Layers of compressed bytes that stand as escapes, some of them as the characters themselves."""
        at = 0
        while m := begin.search(self.text, at):
            ends: list[int] = []

            def read(start: int = m.start(), ends: list[int] = ends) -> Iterator[bytes]:
                ends.clear()
                part, place, size = bytearray(), start, 1 << 6  # most beginnings are none, which a few bytes show
                while x := byte.match(self.text, place):
                    place = x.end()
                    part.append(int(x[1], 16) if x[1] else SHORT[x[2]] if x[2] in SHORT and byte is BYTE_X else ord(x[0]))
                    ends.append(place)
                    if len(part) == size:
                        yield bytes(part)
                        part.clear()
                        size = min(4 * size, 1 << 12)
                if part:
                    yield bytes(part)

            rest: list[int | None] = []
            first = next(iter(_inflated(read())), None)
            if first is None:
                at = m.start() + 1
                continue
            for _ in _inflated(read(), rest):
                pass
            used = ends[max(len(ends) - (rest[0] or 0), 1) - 1]
            yield from self._packed(_unpacked(read), m.start(), used)
            at = m.start() + 1 if rest[0] is None else used

    def inner(self) -> Iterator[Layer]:
        if "%" in self.text and (x := self.unescape("url", URL)):
            yield x
        if "%" in self.text:
            yield from self.escaped(PACKED_URL, BYTE_URL)
        if "\\" in self.text and (x := self.unescape("unicode", UNICODE)):
            yield x
        if "\\" in self.text:
            yield from self.escaped(PACKED_X, BYTE_X)
        if ("\\" in self.text or "%u" in self.text) and (x := self.unescape("more", MORE)):
            yield x
        if "&#" in self.text and (x := self.unescape("entity", ENTITY)):
            yield x
        yield from self.unpack()


def find_secrets(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(kind, start, end) in the text as it stands, and of all layers together, both by start, kind, end."""
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    base = sorted(scan(text), key=order)
    every, seen = set(base), {Layer(text).mark()}

    def follow(first: Layer) -> None:
        work = [first]
        while work:
            for layer in work.pop().inner():
                mark = layer.mark()
                if mark in seen:
                    continue
                seen.add(mark)
                every.update((kind, *layer.origin(s, e)) for kind, s, e in scan(layer.text))
                if layer.window:
                    follow(layer)  # at once: windows are never held together
                else:
                    work.append(layer)

    follow(Layer(text))
    return base, sorted(every, key=order)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, ``base`` and ``found``, arrays of (kind, start, end) in code points, end exclusive.

    ``base`` holds what stands in the text itself, ``found`` that and what stands in decoded layers, each span once.
    A null text counts as empty and finds nothing; repeated rows give a row each; other columns are ignored; texts may be of any
    length; an empty table gives no rows.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_secrets(t) for t in batch.column(1).to_pylist()]
            both = [pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in f[k]] for f in found], span) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *both], ["doc_id", "base", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, base {spans}, found {spans}")


def digest(found: DataFrame) -> DataFrame:
    """scan_secrets' rows as counts by kind, the digest of the base spans, and all spans as text."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("found").alias("spans"))
