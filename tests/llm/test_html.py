"""Main text: messages against enumeration, extraction against a plain parse of the article, and other layouts."""

import html
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from colloquy.functions.markup import read_page
from colloquy.llm import html_extraction as h
from tests.llm.fixtures import CLASHES

SF_DIR = "/root/testdata/sf0.01"


def article(source):
    """The article's blocks by regular expressions."""
    source = re.search(r"<article>(.*)</article>", source, re.DOTALL)[1]
    parts = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\x01", source))).split("\x01")
    return "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)


@pytest.fixture(scope="module")
def given(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()]


@pytest.fixture(scope="module")
def model(given):
    counts = Counter()
    for row in given:
        h.count_page(read_page(row["html"]), zlib.crc32(row["html"].encode()) % 2 == 0, counts)
    return h.Model(counts)


def extract(source, model):
    page = read_page(source)
    return "\n".join(b.text for b, share in zip(page.blocks, h.content_shares(page, model, {}), strict=True) if share >= 0.5)


@pytest.mark.parametrize("seed", range(30))
def test_marginals_equal_enumeration(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 8))
    parents = [-1] + [int(rng.integers(0, n)) for n in range(1, size)]
    fits = rng.random((size, 3)) + 1e-3
    links = rng.random((size, 3, 3)) * (rng.random((size, 3, 3)) < 0.8) + 1e-6
    top = rng.random(3) + 0.01
    want = np.zeros((size, 3))
    for states in itertools.product(range(3), repeat=size):
        p = top[states[0]]
        for n, state in enumerate(states):
            p *= fits[n][state] * (links[n][states[parents[n]]][state] if n else 1)
        for n, state in enumerate(states):
            want[n][state] += p
    want /= want.sum(1, keepdims=True)
    got = h.marginals(parents, fits.tolist(), links.tolist(), tuple(top))
    assert np.allclose(got, want, atol=1e-9)


def test_given_pages_and_without_their_label(given, model):
    for row in given:
        want = article(row["html"])
        assert extract(row["html"], model) == want, row["page_id"]
        bare = row["html"].replace("<article>", "<div>").replace("</article>", "</div>")
        assert extract(bare, model) == want, row["page_id"]


COMMENTS = (
    '<section class="comments"><h2>Comments</h2><div class="comment"><p>I really liked this long article, and wanted to say so in many '
    "words, thank you.</p></div></section><form><p>Write to us about everything here.</p><input></form>"
)
ASIDE = (
    '<aside><h3>Related</h3><p>Read this long and interesting text about other matters of the day.</p></aside>'
    '<div id="cookie-banner"><p>We use cookies to make this page better for everyone.</p></div>'
)
HEADER = '<header><a href="/">Site</a> Welcome to our pages.</header>'
LAYOUTS = {
    "main": (HEADER + ASIDE + "<main><article>", COMMENTS + "</article></main>"),
    "named": (HEADER + ASIDE + '<div class="post-content">', "</div>" + COMMENTS),
    "plain": (HEADER + '<div><div class="row">', "</div></div>" + COMMENTS + ASIDE),
    "many comments": ('<div class="has-sidebar"><section>', "</section></div>" + COMMENTS * 30),
    "form around all": ("<form><div>", "</div></form>"),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_other_layouts(given, model, layout):
    before, after = LAYOUTS[layout]
    right = sum(extract(r["html"].replace("<article>", before).replace("</article>", after), model) == article(r["html"]) for r in given)
    assert right >= 0.95 * len(given)


def test_headline_in_a_header_of_the_article(given, model):
    row = given[0]
    source = row["html"].replace("<article>", "<article><header>").replace("</h1>", "</h1></header>")
    assert extract(source, model) == article(row["html"])


def test_deep_wide_and_empty_pages(model):
    assert extract(None, model) == extract("", model) == extract(" <p> ", model) == ""
    assert extract("<nav>a</nav><article></article><div class=ad>An ad here.</div>", model) == ""
    deep = "<div>" * 3000 + "<p>" + "Some words of text. " * 20
    assert extract("<article>" + deep, model) == ("Some words of text. " * 20).strip()
    wide = "<article>" + "<p>Some words of a paragraph, and more.</p>" * 20_000 + "</article><footer>end</footer>"
    assert extract(wide, model).count("\n") == 19_999


def test_operator(spark, given, model):
    rows = [(r["page_id"], r["html"]) for r in given[:20]] + [(None, None), (-1, ""), (10**9, "<p>x"), (10**9, "<p>x")]
    pages = spark.createDataFrame([(i, s, *CLASHES) for i, s in rows], "page_id long, html string, " + ", ".join(
        f"`{n}` {k}" for n, k in [("row", "long"), ("group", "string"), ("rest", "string"), ("size", "int"), ("hash", "long"), ("fp", "long"),
        ("score", "string"), ("doc", "string"), ("kept", "int"), ("word", "string"), ("bytes", "string"), ("label", "int"), ("weight", "double"), ("host", "string"), ("id", "long")]
    )).repartition(3)
    out = h.main_text(pages, carry=True).collect()
    assert len(out) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) and r["doc"]["host"] == "h" for r in out)
    texts = {r["page_id"]: r for r in out}
    for row in given[:20]:
        assert texts[row["page_id"]]["text"] == article(row["html"])
        kept = [b["text"] for b in texts[row["page_id"]]["blocks"] if b["content"] >= 0.5]
        assert "\n".join(kept) == article(row["html"])
    nothing = pages.filter("page_id > 10000000000")
    assert h.main_text(nothing).count() == 0
    nulls = spark.createDataFrame([(None, None)] * 3, "page_id long, html string")
    assert [r["text"] for r in h.main_text(nulls, blocks=False).collect()] == [""] * 3
