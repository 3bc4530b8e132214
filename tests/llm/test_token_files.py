"""Token files against the tokenizers library, read back whole, by sequence and by document."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from waymark.llm import token_files
from waymark.llm.queries import op11_token_files, tokenizer

TEXTS = ["plain words here", None, "", "a  b   c \n d\t e", " \n \n", "x<|endoftext|>y", "été ﬁn ١٢٣ 日本語 \U0001f600", "don't 12345 _under_ \x1c\x85 z", "tail spaces   ", "word " * 3000]


def expected(rows, end=2):
    t, at, out = Tokenizer.from_file(tokenizer()), 0, []
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize(("length", "file_tokens"), [(7, 1 << 20), (2048, 50), (1, 1 << 20)])
def test_read_back_equals_the_library(spark, length, file_tokens):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3)
    manifest = token_files.write(docs, tokenizer(), length=length, file_tokens=file_tokens)
    got = token_files.read_documents(manifest).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected(rows)


def test_sequences_are_views_with_masks(spark):
    docs = spark.createDataFrame([(i, f"document number {i} " * 9) for i in range(40)], "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        manifest = token_files.write(docs, tokenizer(), length=16).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    whole = [i for r in sorted(docs.collect()) for i in [*Tokenizer.from_file(tokenizer()).encode(r["text"], add_special_tokens=False).ids, 2]]
    seen = []
    for m in sorted(manifest, key=lambda r: r["base"]):
        f = token_files.TokenFile(m["file"])
        for i in range(m["sequences"]):
            ids, mask = f.sequence(i)
            assert len(ids) == len(mask) == 16 and not ids.flags.owndata
            assert f.source.address <= ids.ctypes.data < f.source.address + f.source.size() if hasattr(f.source, "address") else True
            seen += ids[mask].tolist()
            assert mask.all() or i == m["sequences"] - 1
        assert m["base"] + m["tokens"] <= len(whole)
    assert seen == whole


def test_rows_of_one_id_nulls_and_clashing_columns(spark):
    rows = [(1, "same", 5), (1, "same", 6), (1, "other", 7), (None, "no id", 8), (None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place long").withColumn("hash", docs_hash()).withColumn("tokens", docs_hash())
    got = token_files.read_documents(token_files.write(docs, tokenizer())).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(n for _, _, n, _ in expected([(a, b) for a, b, _ in rows]))
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == [None, None, 1, 1, 1]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(ordered, ordered[1:], strict=False))
    assert abs([r["ids_crc32"] for r in ordered[2:]].count(expected([(1, "same")])[0][3])) == 2


def docs_hash():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_no_documents(spark):
    manifest = token_files.write(spark.createDataFrame([], "doc_id long, text string"), tokenizer())
    assert manifest.count() == 0 and token_files.read_documents(manifest).count() == 0


def test_text_ids_and_a_very_long_text(spark):
    long = "Lorem ipsum dolor, sit amet 42! " * 40_000
    docs = spark.createDataFrame([("b", long), ("a", "x")], "doc_id string, text string")
    got = token_files.read_documents(token_files.write(docs, tokenizer(), length=512)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected([("a", "x"), ("b", long)])


def test_registered_query_over_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert [tuple(r) for r in op11_token_files(spark, sf_dir).orderBy("doc_id").collect()] == expected(docs)
