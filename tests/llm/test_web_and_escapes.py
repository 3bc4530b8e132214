"""Inline boilerplate, forms, compound names, teasers and hidden text; escapes, glued base64, and texts full of false beginnings; no labels at all."""

import base64
import time
import zlib

import pytest

from waymark.llm import html_text, toxicity
from waymark.llm.html_text import KEEP, MAIN, blocks
from waymark.llm.secrets import find_secrets

SECRET = 'password = "hunter2hunter2"'


def main(page):
    return [text for zone, text in blocks(page) if zone == MAIN]


@pytest.mark.parametrize("inline", ['<span class="ad">BUY</span>', "<button>B</button>", "<label>L</label>", '<a class="share">S</a>', "<b hidden>H</b>", '<x-y role="complementary">C</x-y>', '<span style="color: red; display: none">H</span>', '<i aria-hidden="true">H</i>'])
def test_inline_boilerplate_leaves_its_block_whole(inline):
    assert main(f"<article><p>text {inline} more <b>bold</b></p><p>next</p></article>") == ["text more bold", "next"]


@pytest.mark.parametrize(("name", "goes"), [(n, True) for n in "related-posts ad-banner advertisement-top google-ads newsletter-signup reader-comments disqus_thread ad-slot share-buttons comments-area".split()] + [(n, False) for n in "no-comments has-ads article-header share-price related-work read-more thread card loads".split()])
def test_compound_names(name, goes):
    assert main(f'<article><p>keep</p><div class="{name}"><p>other</p></div></article>') == (["keep"] if goes else ["keep", "other"])


def test_forms_teasers_and_frames():
    assert main('<form id="aspnetForm"><nav>n</nav><article><p>x</p><form><p>reply</p></form></article></form>') == ["x"]
    assert [t for z, t in blocks("<body><form><div><p>a</p><p>b</p><p>c</p></div></form><form><p>search</p></form></body>") if z == KEEP] == ["a", "b", "c"]
    assert main('<article><p>m</p></article><article class="teaser"><p>t</p></article>') == ["m"] and main('<article class="teaser"><p>t</p></article>') == ["t"]


def test_a_very_long_page(spark):
    page = "<article>" + "<p>one <span class='ad'>x</span>two</p>" * 60_000 + "</article>"
    got = html_text.extract(spark.createDataFrame([(1, "http://a.org/", page)], "page_id long, url string, html string")).first()
    assert got["text"] == "\n".join(["one two"] * 60_000)


def spans(text):
    return [x for x in find_secrets(text)[1] if x not in find_secrets(text)[0]]


def test_more_escapes_and_glued_base64():
    code = base64.b64encode(SECRET.encode()).decode()
    for text, start in ((f"data/{code}", 5), (f"k_{code} z", 2), (f"x-y-key-{code}", 8), (f"a/b/c/d/{code}", 8)):
        assert ("assign", start, start + 35) in spans(text), text
    for form in ("%%u%04x", "\\U%08x", "\\%03o"):
        whole = "".join(form % ord(c) for c in SECRET)
        assert ("assign", 0, len(whole) - len(form % 34)) in spans(whole) or ("assign", 0, len(whole)) in spans(whole), form
    raw = base64.b64encode(zlib.compress(SECRET.encode() * 3)[2:-4]).decode().rstrip("=")
    assert spans(raw) and spans(f"dir/{base64.b64encode(zlib.compress(SECRET.encode() * 3)).decode()}")


def test_texts_full_of_false_beginnings():
    began = time.process_time()
    assert find_secrets("Let \\alpha be x^2 + y, about 5% of it, and \\beta = x^{3}. " * 1000) == ([], [])
    assert time.process_time() - began < 2
    began = time.process_time()
    find_secrets("%78^" * 20_000)
    assert time.process_time() - began < 8


def test_without_labels_nothing_is_dropped(spark):
    docs = spark.createDataFrame([(1, "some text", "s"), (2, None, "s"), (None, "", None)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.keep_clean(docs, toxicity.train(docs, labels)).count() == 3
