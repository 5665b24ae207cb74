"""Pages as blocks and chunks, against a parser of the standard library."""

import html.parser
import time

import pyarrow as pa
import pytest

from colloquy.functions.jsontext import canonical_json
from colloquy.functions.markup import HIDDEN, read_page
from colloquy.operators import pages as p

SF_DIR = "/root/testdata/sf0.01"


class Plain(html.parser.HTMLParser):
    """Texts between block tags, for pages without errors of nesting."""

    BLOCK = {"html", "head", "body", "nav", "ul", "ol", "li", "div", "article", "h1", "h2", "p", "footer", "table", "tr", "td", "section"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts, self.hidden, self.part = [], 0, []

    def cut(self):
        text = " ".join("".join(self.part).split())
        self.texts += [text] if text else []
        self.part = []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN
        if tag in self.BLOCK:
            self.cut()
        elif tag == "br":
            self.part.append(" ")

    def handle_endtag(self, tag):
        self.hidden -= tag in HIDDEN
        if tag in self.BLOCK:
            self.cut()

    def handle_data(self, data):
        if not self.hidden:
            self.part.append(data)


def plain(source):
    parser = Plain()
    parser.feed(source)
    parser.close()
    parser.cut()
    return parser.texts


def texts(source):
    return [b.text for b in read_page(source).blocks]


def test_given_pages_equal_a_plain_parser(spark):
    for row in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect():
        assert texts(row["html"]) == plain(row["html"]), row["page_id"]


@pytest.mark.parametrize(
    "source,want",
    [
        (None, []),
        ("", []),
        (" \n ", []),
        ("no markup & none needed", ["no markup & none needed"]),
        ("<p>one<p>two<div>three", ["one", "two", "three"]),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("a<script>if (x < 1) '<p>no</p>'</script>b", ["ab"]),
        ("a<script>never closed <p>b", ["a"]),
        ("a<!-- <p>hidden --> b<!-- open", ["a b"]),
        ("a<!-->b", ["ab"]),
        ("1 < 2 and 3 > 2<br>next", ["1 < 2 and 3 > 2 next"]),
        ('<p title="a > b">text</p>', ["text"]),
        ("<p title='never closed>text</p>", ["text"]),
        ("</p></div>stray", ["stray"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("x&amp;y &lt;b&gt; &#233;&eacute &amp", ["x&y <b> éé &"]),
        ("<h1>a<h2>b</h2>c", ["a", "b", "c"]),
        ("<P>Upper</P><DIV>case", ["Upper", "case"]),
        ("<textarea><p>typed</textarea>after", ["after"]),
        ("text <b", ["text"]),
    ],
)
def test_broken_markup(source, want):
    assert texts(source) == want


def test_nesting_and_links():
    page = read_page("<title>T &amp; t</title><ul><li>a <a href=x>b c</a><ol><li>d</ol></ul><p>e")
    tags = [(page.elements[b.element].tag, page.elements[page.elements[b.element].parent].tag, b.linked) for b in page.blocks]
    assert page.title == "T & t"
    assert tags == [("li", "ul", 3), ("li", "ol", 0), ("p", "#page", 0)]


@pytest.mark.parametrize(
    "unit", ["<", "<a ", "<div>", '<a href="', "<!--", "<script>", '<a b="c>', "</div", "<li>", "<a =\"'>", '<a =">="', "<p>word ", "&amp;&", "<td><table>"]
)
def test_hostile_pages_take_linear_time(unit):
    def took(n):
        began = time.process_time()
        read_page(unit * n + ">")
        return time.process_time() - began

    size = 400_000 // len(unit)
    assert took(8 * size) < 24 * max(took(size), 0.02)


def test_page_of_ten_megabytes(spark):
    html_text = "<title>Long</title>" + "".join(f"<h2>Part {n}</h2><p>{'word ' * 90}<p>end {n}" for n in range(20_000))
    pages = spark.createDataFrame([(1, html_text), (2, None), (3, "")], "page_id long, html string")
    rows = p.page_paragraphs(pages).collect()
    assert len(rows) == 60_000 and [r["position"] for r in rows] == list(range(60_000))
    assert rows[-1]["heading"] == "Part 19999" and {r["title"] for r in rows} == {"Long"}
    chunks = p.page_chunks(pages, 5_000).collect()
    assert "\n".join(c["text"] for c in chunks) == "\n".join(r["text"] for r in rows)
    assert sum(c["paragraphs"] for c in chunks) == 60_000
    # No paragraph is cut: a chunk ends with the first that begins beyond its part.
    assert max(len(c["text"]) for c in chunks) < 5_000 + 500


def test_deep_json_is_bad_json(spark):
    deep = "[" * 100_000 + "]" * 100_000
    df = spark.createDataFrame([(deep,), ('{"a": 1}',)], "text string")
    assert [r[0] for r in df.select(canonical_json("text")).collect()] == [None, '{"a": 1}']


def test_chunks_leave_as_they_fill_and_not_a_batch_at_a_time(spark, monkeypatch):
    """One batch of pages, among them large, null and empty ones: many batches of chunks, the same rows in order."""
    shown = ["<p>" + "w" * (n % 90 + 1) + "</p>" for n in range(40)]
    sources = ["<title>T</title><h1>H</h1>" + "".join(shown)] * 900 + [None, "", "<h1>big</h1>" + "".join(shown) * 900, "<p>end</p>"]
    seen = {}
    monkeypatch.setattr(p, "HELD_CHARS", 50_000)
    frame = type(spark.range(0))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, kind: seen.setdefault("f", f) and self)
    p.page_chunks(spark.createDataFrame([], "page_id long, html string"), 200)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sources))), pa.array(sources, pa.string())], names=["page_id", "html"])
    found = list(seen["f"](iter([batch])))
    assert len(found) > 20
    assert max(sum(len(t) for t in b.column(5).to_pylist()) for b in found) < p.HELD_CHARS + 1000
    rows = [row for b in found for row in zip(*[c.to_pylist() for c in b.columns], strict=True)]
    alone = [row for n in range(batch.num_rows) for b in seen["f"](iter([batch.slice(n, 1)])) for row in zip(*[c.to_pylist() for c in b.columns], strict=True)]
    assert rows == alone and {r[0] for r in rows} == set(range(len(sources))) - {900, 901}
    for n in (0, 902):
        lines = "\n".join(r[5] for r in rows if r[0] == n).split("\n")
        assert lines[1:] == [s[3:-4] for s in shown] * (1 if n == 0 else 900)
