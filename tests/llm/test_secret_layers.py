"""Layers that a secret scan must not leave out."""

import base64
import bz2
import gzip
import hashlib
import lzma
import re
import zlib
from urllib.parse import quote_from_bytes

import numpy as np
import pytest

from tests.llm.test_corpus import base_spans
from waymark.llm import secrets

KEY = "AKIA" + "Q7" * 8


def b64(raw):
    return base64.b64encode(raw).decode()


@pytest.mark.parametrize("mark", [" ", "　", "​", "‍", "﻿", "\f", "\0", "\x1b"])
def test_layers_with_unprintable_characters(mark):
    run = b64(f"{mark}été {KEY} {mark}".encode())
    twice = b64(f"{mark} {run} {mark}".encode())
    for text in (run, twice):
        base, found = secrets.find_secrets(f"see {text} end")
        assert base == [] and [k for k, _, _ in found] == ["access"]
        assert all(4 <= s < e <= 4 + len(text) for _, s, e in found)


def test_layers_that_are_not_utf8():
    head = b"\xff\xfe\x80 "
    text = "see " + b64(head + KEY.encode() + b" \xe9")
    (kind, s, e), = secrets.find_secrets(text)[1]
    assert (kind, s, e) == ("access", 4 + len(head) * 4 // 3, 4 + ((len(head) + 20) * 4 + 2) // 3)


def kinds(text):
    base, found = secrets.find_secrets(text)
    assert base == []
    return found


def gz(raw):
    return gzip.compress(raw, mtime=0)


def wrapped(run, width, line="\n"):
    return line.join(run[i : i + width] for i in range(0, len(run), width))


@pytest.mark.parametrize("pack", [gz, zlib.compress, bz2.compress, lzma.compress])
def test_compressed_bytes_wherever_they_stand(pack):
    noise = "".join(np.random.default_rng(3).choice(list("ghijkz \n"), 400)).encode()
    raw = pack(noise + f" {KEY} é ".encode())
    url, hexes = "".join(f"%{b:02x}" for b in raw), "".join(f"\\x{b:02X}" for b in raw)
    for run in (b64(raw), url, hexes, b64(b64(raw).encode()), b64(pack(raw)), wrapped(b64(raw), 64), wrapped(b64(raw), 76, "\r\n")):
        (kind, s, e), = kinds(f"see {run} end")
        assert kind == "access" and s == 4 and len(run) - 16 <= e - 4 <= len(run)  # all of it, but for padding
    for run in (quote_from_bytes(raw), repr(raw)):
        assert [k for k, _, _ in kinds(f"see {run} end")] == ["access"]


@pytest.mark.parametrize("pack", [gz, bz2.compress, lzma.compress])
def test_all_members_of_a_stream(pack):
    run = b64(pack(b"one " * 9) + pack(f"two {KEY} ".encode()) + pack(b"password = hunter2x"))
    assert sorted({k for k, _, _ in kinds(f"see {run}")}) == ["access", "assign"]


def test_long_decompressed_layers(monkeypatch):
    long = ("naïve words " * (11 << 19)).encode()  # 71 MiB
    run = b64(gzip.compress(long + f" {KEY} ".encode(), 1))
    assert [k for k, _, _ in kinds(f"see {run}")] == ["access"]
    for name, n in (("PIECE_BYTES", 64), ("WINDOW_BYTES", 512), ("OVERLAP_BYTES", 64)):
        monkeypatch.setattr(secrets, name, n)
    for shift in range(0, 600, 7):  # a secret, and an encoded run, across any border of two windows
        inner = gzip.compress(f"{'z' * 99} password = hunter2x".encode())
        run = b64(gzip.compress(b"ab " * 150 + b"." * shift + b" " + KEY.encode() + b" " + b64(inner).encode() + " é".encode()))
        assert {k for k, _, _ in kinds(f"see {run}")} == {"access", "assign"}, shift


def test_secrets_across_lines_of_base64():
    run = b64(b"x" * 40 + KEY.encode() + b"y y" * 30)
    text = "-----BEGIN DATA-----\n" + wrapped(run, 64) + "\n-----END DATA-----\n"
    (kind, s, e), = kinds(text)
    lead = text.index(run[:64])
    assert kind == "access" and (s, e) == (lead + 40 * 4 // 3, lead + (60 * 4 + 2) // 3 + 1)  # one line break stands between
    assert text[s:e].count("\n") == 1


def test_each_copy_of_an_encoded_secret_is_found():
    run = base64.b64encode(b"password=hunter2222").decode()
    text = f"one {run} two {run} three {run}"
    spans = [x for x in secrets.find_secrets(text)[1] if x[0] == "assign"]
    assert [s for _, s, _ in spans] == [m.start() for m in re.finditer(re.escape(run), text)]
    packed = base64.b64encode(gzip.compress(b"token: abcdefgh " * 3)).decode()
    text = f"{packed} and {packed}"
    assert {s for _, s, _ in secrets.find_secrets(text)[1]} == {0, len(packed) + 5}
    url = "secret%3Dabcdef1 x secret%3Dabcdef1"
    assert [x[1:] for x in secrets.find_secrets(url)[1]] == [(0, 16), (19, 35)]


def test_digest_rows(spark):
    """The query's columns against a plain version: texts of secrets, half secrets, odd characters, and a very long one."""
    rng = np.random.default_rng(3)
    parts = ["password = hunter22", "TOKEN:'abc'", "api_key=a+b/c_d.e=f-g", "AKIA" + "A1" * 8, "AKIA" + "Z" * 15, "f" * 24, "0" * 23, "\u00e9\U0001f600", "secret: : x", "word", "\n", "\x00", "Api-Key=abcdefgh", "passwd\"  =  \"qwertyuiop"]
    texts = [" ".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(200)] + ["", None, "a" * 3_000_000, "x " * 500_000 + "token=abcdefghij"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "y")], "doc_id long, text string, base string")
    got = secrets.digest(secrets.scan_secrets(df)).collect()
    assert len(got) == len(texts) + 1 and secrets.digest(secrets.scan_secrets(df.limit(0))).count() == 0
    for r in got:
        base = base_spans(texts[r["doc_id"]] or "")
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[0] == k for x in base) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and set(filter(None, said.split(","))) <= set(r["spans"].split(","))
