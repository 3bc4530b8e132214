"""The corpus pipeline on a small corpus with planted cases, against brute force stage by stage."""

import re

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_corpus import overlap_truth
from tests.llm.test_near_copies import similarity


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    words = [f"word{i}" for i in range(3000)]
    bench = [(i, " ".join(rng.choice(words, 25))) for i in range(5)]
    rows, labels = [], []
    for i in range(700):
        ws = list(rng.choice(words, rng.integers(60, 200)))
        toxic = i % 4 == 0
        if toxic:
            ws[10:10] = ["vile", "nasty", "rotten"]
        if i % 50 == 1:
            ws[5:5] = bench[i % 5][1].split()[3:16]
        rows.append((i, " ".join(ws), "en", f"s{i % 3}", 0))
        if i < 600:
            labels.append((i, 1, int(toxic)))
    for k, i in enumerate((2, 3, 6, 7, 10)):
        rows.append((2000 + k, rows[i][1].replace(" ", "  "), "en", "s0", 0))  # exact copies
        ws = rows[i][1].split()
        ws[len(ws) // 2] = "changed"
        rows.append((3000 + k, " ".join(ws), "en", "s1", 0))  # near copies
    rows += [(4000, None, None, None, None), (4001, "", "en", "s2", 0)]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, bench


def test_pipeline(spark, corpus):
    at, rows, bench = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    seen, columns = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = f"{at}/{name}"
        stage(spark, seen[-1], at).write.parquet(path)
        seen.append(spark.read.parquet(path))
    ids = [[r["doc_id"] for r in d.select("doc_id").collect()] for d in seen]
    text = {r[0]: r[1] or "" for r in rows}
    assert all(d.columns == columns for d in seen[:-1])

    toxic = {i for i, t in text.items() if "vile" in t.split()}
    assert len(toxic & set(ids[1])) <= 0.05 * len(toxic) and set(ids[0]) - toxic <= set(ids[1])

    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", text[i]) for i in ids[1]}
    assert set(ids[2]) == {min(j for j in norm if norm[j] == norm[i]) for i in norm}

    near = {3000 + k for k in range(5)}
    assert near <= set(ids[2]) and all(similarity(text[3000 + k], text[i]) >= 0.8 for k, i in enumerate((2, 3, 6, 7, 10)))
    assert set(ids[3]) == set(ids[2]) - near

    assert sorted(ids[4]) == sorted(i for i in ids[3] if not overlap_truth(text[i], bench)[3])

    last = seen[5].collect()
    size = {i: len(text[i].split()) for i in ids[4]}
    assert {r["doc_id"] for r in last} <= set(ids[4]) and all(r["copies"] in (1, 2) and r["size"] == size[r["doc_id"]] for r in last)
    for s in ("s0", "s1", "s2"):
        mine = [r for r in last if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) <= 220
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, at).collect()) == sorted(r["doc_id"] for r in last)
