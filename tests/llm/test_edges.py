"""Reuse of a deduplication's folder, contradicting labels, empty tables and clashing columns, pages that declare no article."""

import numpy as np
import pytest

from waymark.llm import exact_dedup, html_text, quality, toxicity


@pytest.mark.parametrize("digits", [64, 0])
def test_a_later_run_meets_earlier_rows(spark, tmp_path, digits):
    """Two runs over one folder, with a digest that is right and with one that tells no texts apart."""
    from pyspark.sql import functions as F

    weak = (lambda t: F.substring(F.sha2(t, 256), 1, digits)) if digits < 64 else exact_dedup.sha256
    first = spark.createDataFrame([(1, "a  b", "x"), (2, "c", "x")], "doc_id long, text string, digest string")
    then = spark.createDataFrame([(3, "a b", "y"), (4, "d", "y"), (0, "c", "y")], "doc_id long, text string, digest string")
    kept = lambda df: sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect())
    at = f"file://{tmp_path}/run"
    assert kept(exact_dedup.deduplicate(first, digest=weak, run_dir=at)) == [(1, 1, 1, True), (2, 2, 1, True)]
    again = exact_dedup.deduplicate(then, digest=weak, run_dir=at)
    assert kept(again) == [(0, 0, 2, True), (1, 1, 2, True), (2, 0, 2, False), (3, 1, 2, False), (4, 4, 1, True)]


@pytest.mark.parametrize("module", [toxicity, quality])
def test_labels_that_contradict(spark, module):
    rows = [(i, ("bad " if i % 2 else "good ") * 20 + f"w{i}", 1, "x") for i in range(200)]
    docs = spark.createDataFrame(rows + [(3, "another text of one id", 0, "y"), (None, None, None, None), (500, "", 0, "z")], "doc_id long, text string, label int, l_id string")
    one = [(i, i % 2, i % 2) for i in range(200)]
    clean = spark.createDataFrame(one, "doc_id long, toxic int, quality int")
    extra = spark.createDataFrame(one + [(900, 1, 1), (900, 0, 0), (900, 1, 1)], "doc_id long, toxic int, quality int")
    some = lambda labels: sorted((str(r["doc_id"]), r["score"]) for r in module.score(docs, module.train(docs, labels)).collect())
    got = some(clean)
    assert got == some(extra) and len(got) == 203
    torn = spark.createDataFrame(one + [(i, 1 - i % 2, 1 - i % 2) for i in range(200)], "doc_id long, toxic int, quality int")
    assert len({s for _, s in some(torn)}) == 1  # nothing is learnt
    assert module.score(docs.limit(0), module.train(docs.limit(0), clean.limit(0))).count() == 0


def test_names_never_drop_an_article():
    main = lambda page: [t for z, t in html_text.blocks(page) if z == html_text.MAIN]
    assert main('<div class="site has-footer-widgets"><article class="post tag-social"><div class="article-header"><h1>A</h1></div><p class="share-price">B</p></article></div>') == ["A", "B"]
    assert main('<main class="has-sidebar"><h2 id="related-work">C</h2><p>D<svg viewBox="0"/>E</p><div class="ad-slot">x</div></main>') == ["C", "DE"]
    assert main("<html><head><title>T</title><body><article><p>F</p><section class='comments'><article>no</article></section></article>") == ["F"]
    assert main('<div class="widget"><article>G</article></div>') == ["G"]


def test_passages_and_copies_of_a_large_host(spark):
    """Undeclared pages: what a few of a host's many pages share stays, and so do whole copies; what all share goes."""
    rng = np.random.default_rng(2)
    boiler = "all rights are with the owner of this site and with nobody else"
    passage = "a passage of more than eight words that four of the many pages quote in full"
    rows = []
    for i in range(60):
        own = " ".join(f"w{x}" for x in rng.integers(0, 9999, 30))
        rows.append((i, "http://big.org/x", f"<div>{own}</div>" + (f"<p>{passage}</p>" if i < 4 else "") + f"<div>{boiler}</div>", "x", 1))
    rows += [(100 + k, "http://big.org/y", rows[9][2], "x", 1) for k in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, blocks int")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert all(boiler not in t and t for t in got.values()) and all(passage in got[i] for i in range(4))
    assert {got[100 + k] for k in range(20)} == {got[9]} and len(got[9].split()) == 30
    assert html_text.extract(df.limit(0)).count() == 0
