"""Main text of web pages by a graphical model over the tree of their blocks.

The nodes are a page's block elements and, as leaves, its blocks of text. Each is boilerplate, content or
(elements only) a frame that holds both. Potentials between parent and child say how states
follow each other down the tree; potentials of a single node say how well its tag, the names of its class,
id and role, or the length, links and ending of its text fit each state. Messages are passed
upward from the leaves and downward from the page (sum-product, exact on a tree) and leave
the marginal of every block; a block is kept when content has at least half of it.

The potentials are learned from pages that label their own main text by ``article`` or ``main``: counts of
states along their trees, mixed with fixed shares for what such pages don't show. In every other page learned from,
the label itself is hidden, so that texts and places count where a page has no such element.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.markup import Element, Page, read_page
from colloquy.llm.common import doc_column

BOILERPLATE, CONTENT, FRAME = STATES = range(3)
#: Labelled pages that potentials are learned from, at most about.
SAMPLE = 20_000
#: Hashed names of classes, ids and roles, and elements whose potentials a task remembers.
NAMES, REMEMBERED = 4096, 50_000

# What elements and names are for, by the HTML standard and by custom.
ARTICLE_TAGS = frozenset(("article", "main"))
OTHER_TAGS = frozenset(("aside", "dialog", "fieldset", "footer", "form", "header", "head", "legend", "menu", "nav", "search"))
CONTENT_NAMES = frozenset("article articlebody body content entry main maincontent post story text".split())
OTHER_NAMES = frozenset(
    "ad ads adsense adslot advert advertisement adverts alert banner banners breadcrumb breadcrumbs byline captcha comment commentlist comments "
    "complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion disqus dropdown feedback footer footnav form gdpr "
    "header login masthead menu menubar modal nav navbar navigation newsletter notice notification outbrain pager pagination paywall popup "
    "privacy promo promoted promotion recommended related replies reply respond search searchbox share sharing sidebar sidenav signup skip "
    "skyscraper social sponsor sponsored subscribe subscription taboola teaser toolbar topbar widget widgets".split()
)
#: Names like has-sidebar say something about another element.
ABOUT_OTHERS = frozenset("has hide no not show with without".split())

#: Shares of states at the top and below each state, for what the labelled pages don't show.
TOP = (0.01, 0.09, 0.9)
BELOW = ((1.0, 0.0, 0.0), (0.05, 0.949, 0.001), (0.4, 0.3, 0.3))
#: Boilerplate that says so may stand anywhere, and says nothing about what is around it.
ANYWHERE = [(1.0, 0.0, 0.0)] * 3
#: Part of those shares in the mixture with counted ones.
MIXED = 0.1
#: How likely a node in each state is hinted at as boilerplate, as content, and not at all. What is called boilerplate is.
HINTS = ((0.5, 1e-7, 0.5), (0.0, 0.2, 0.8), (0.0, 0.1, 0.9))
#: Least part of a counted feature, in counts, and the power of the features' potentials: they are not independent.
FLOOR, POWER = 2.0, 0.5

#: No message rules a state out altogether: it would be a matter of rounding.
LEAST = 1e-280

SIZES = (1, 3, 6, 13, 31)


def hint(tag: str, names: list[str]) -> int:
    """0 for names and tags of boilerplate, 1 for those of content, 2 for none. The body is what it is."""
    if tag in OTHER_TAGS:
        return 0
    if tag in ("html", "body"):
        return 2
    found = 1 if tag in ARTICLE_TAGS else 2
    for name in names:
        parts = set(re.split(r"[-_\d]+", name))
        if parts & ABOUT_OTHERS:
            continue
        if parts & OTHER_NAMES:
            return 0
        if parts & CONTENT_NAMES:
            found = 1
    return found


def element_features(element: Element, above: str, hidden: bool = False) -> tuple[int, list[tuple[str, str]]]:
    """Hint, and features by kind. A hidden label is any element, and the header of an article may be its headline."""
    tag = "div" if hidden or (element.tag, above) == ("header", "article") else element.tag
    names = element.attribute("class", "id", "role").lower().split() if element.attributes and not hidden else []
    hashed = {str(zlib.crc32(name.encode()) % NAMES) for name in names}
    return hint(tag, names), [("tag", tag), *(("name", name) for name in sorted(hashed))]


def block_features(text: str, linked: int, tag: str) -> list[tuple[str, str]]:
    words = text.count(" ") + 1
    size = sum(words >= least for least in SIZES)
    return [
        ("size", str(size)),
        ("linked", str(min(3, 4 * linked // len(text)))),
        ("end", "stop" if text[-1] in ".!?…»”\"'" else "other"),
        ("in", tag),
    ]


def labelled_states(page: Page) -> tuple[list[int], list[int]] | None:
    """States of elements and blocks as the page's own outermost articles or mains say; None without any."""
    elements = page.elements
    states = [BOILERPLATE] * len(elements)
    tops = []
    for at, element in enumerate(elements[1:], 1):
        if states[element.parent] == CONTENT:
            states[at] = BOILERPLATE if element_features(element, elements[element.parent].tag)[0] == 0 else CONTENT
        elif element.tag in ARTICLE_TAGS:
            states[at] = CONTENT
            tops.append(at)
    if not tops:
        return None
    for at in tops:
        at = elements[at].parent
        while at >= 0 and states[at] == BOILERPLATE:
            states[at] = FRAME
            at = elements[at].parent
    blocks = [CONTENT if states[b.element] == CONTENT else BOILERPLATE for b in page.blocks]
    return states, blocks


def count_page(page: Page, hide: bool, into: Counter) -> None:
    """Adds a labelled page's states along its tree, and its features by state."""
    found = labelled_states(page)
    if found is None:
        return
    states, blocks = found
    into["top", "", states[0]] += 1
    for at, element in enumerate(page.elements[1:], 1):
        into["below", str(states[element.parent]), states[at]] += 1
        label = element.tag in ARTICLE_TAGS and states[element.parent] != CONTENT
        for kind, value in element_features(element, page.elements[element.parent].tag, hide and label)[1]:
            into[kind, value, states[at]] += 1
    for state, block in zip(blocks, page.blocks, strict=True):
        into["leaf", str(states[block.element]), state] += 1
        for kind, value in block_features(block.text, block.linked, page.elements[block.element].tag):
            into[kind, value, state] += 1


class Model:
    """Logarithms and shares of the potentials, from counts by (kind, value, state)."""

    def __init__(self, counts: dict[tuple[str, str, int], float]):
        self.top = self._mixture(TOP, [counts.get(("top", "", s), 0) for s in STATES])
        self.below = [self._mixture(BELOW[p], [counts.get(("below", str(p), s), 0) for s in STATES]) for p in STATES]
        two = [(share[0] / (share[0] + share[1]), share[1] / (share[0] + share[1])) for share in BELOW]
        self.leaf = [(*self._mixture(two[p], [counts.get(("leaf", str(p), s), 0) for s in STATES[:2]]), 0.0) for p in STATES]
        self.known: dict[str, dict[str, tuple[float, ...]]] = {}
        totals: Counter = Counter()
        values: dict[str, set[str]] = {}
        for (kind, value, state), n in counts.items():
            totals[kind, state] += n
            values.setdefault(kind, set()).add(value)
        for kind, some in values.items():
            if kind in ("top", "below", "leaf"):
                continue
            # A value never seen in a state is as likely there as FLOOR counts among all.
            self.known[kind] = {
                value: tuple(
                    math.log((counts.get((kind, value, s), 0) + FLOOR) / (totals[kind, s] + FLOOR * (len(some) + 1))) for s in STATES
                )
                for value in some
            }

    @staticmethod
    def _mixture(fixed: tuple[float, ...], counted: list[float]) -> tuple[float, ...]:
        total = sum(counted)
        if not total:
            return tuple(fixed)
        return tuple(MIXED * f + (1 - MIXED) * c / total if f else 0.0 for f, c in zip(fixed, counted, strict=True))

    def fit(self, features: list[tuple[str, str]]) -> list[float]:
        """Likelihood of the features in each state, the highest being 1; unseen values fit all alike."""
        logs = [0.0, 0.0, 0.0]
        for kind, value in features:
            found = self.known.get(kind, {}).get(value)
            if found is not None:
                logs = [a + b for a, b in zip(logs, found, strict=True)]
        high = max(logs)
        return [math.exp(max(POWER * (x - high), -60.0)) for x in logs]

    def element(self, element: Element, above: str, trusted: bool = True) -> tuple[list[float], list]:
        """Potentials of an element, and those that join it to its parent: none if a hint settles its state."""
        which, features = element_features(element, above)
        if not which and not trusted and element.tag == "form":
            which = 2
        fit = self.fit(features)
        return [f * HINTS[s][which] for s, f in zip(STATES, fit, strict=True)], self.below if which else ANYWHERE

    def block(self, text: str, linked: int, tag: str) -> list[float]:
        return [*self.fit(block_features(text, linked, tag))[:2], 0.0]


def marginals(parents: list[int], fits: list[list[float]], links: list, top: tuple[float, ...]) -> list[list[float]]:
    """Marginal of every node of a tree by messages up and down.

    Parents stand before their children; the first node is the root. ``fits`` are the potentials of single nodes,
    ``links[n][p][s]`` those of node n in state s below a parent in state p.
    """
    below = [list(fit) for fit in fits]
    messages: list[list[float]] = [[]] * len(parents)
    for n in range(len(parents) - 1, 0, -1):
        a, b, c = below[n]
        (aa, ab, ac), (ba, bb, bc), (ca, cb, cc) = links[n]
        x, y, z = aa * a + ab * b + ac * c, ba * a + bb * b + bc * c, ca * a + cb * b + cc * c
        # Only ratios count: sums of 1 keep deep and wide trees from vanishing.
        total = x + y + z
        messages[n] = message = [max(x / total, LEAST), max(y / total, LEAST), max(z / total, LEAST)]
        above = below[parents[n]]
        above[0] *= message[0]
        above[1] *= message[1]
        above[2] *= message[2]
        high = max(above)
        if high < 1e-10:
            below[parents[n]] = [value / high for value in above]
    out: list[list[float]] = []
    for n, parent in enumerate(parents):
        a, b, c = below[n]
        if n == 0:
            x, y, z = top
        else:
            p = out[parent]
            # What reaches the parent from everywhere but this node.
            q, r, s = (v / m for v, m in zip(p, messages[n], strict=True))
            (aa, ab, ac), (ba, bb, bc), (ca, cb, cc) = links[n]
            x, y, z = q * aa + r * ba + s * ca, q * ab + r * bb + s * cb, q * ac + r * bc + s * cc
        x, y, z = x * a, y * b, z * c
        total = x + y + z
        if not total:  # ruled out by what stands above, beyond the range of numbers
            x, y, z = below[n]
            total = x + y + z
        out.append([x / total, y / total, z / total])
    return out


def content_shares(page: Page, model: Model, memory: dict) -> list[float]:
    """Marginal of content for every block of a page.

    Where nothing is left of a page without an ``article`` or ``main``, it may be one form as a whole,
    and is judged as if forms were like any element.
    """
    shares = _shares(page, model, memory, trusted=True)
    tags = {e.tag for e in page.elements}
    if max(shares, default=1.0) >= 0.5 or tags & ARTICLE_TAGS or "form" not in tags:
        return shares
    return _shares(page, model, memory, trusted=False)


def _shares(page: Page, model: Model, memory: dict, trusted: bool) -> list[float]:
    if not page.blocks:
        return []
    elements = page.elements
    fits, links = [[1.0, 1.0, 1.0]], [model.below]
    for element in elements[1:]:
        above = elements[element.parent].tag
        key = (element.tag, element.attributes, above == "article", trusted)
        if key not in memory:
            if len(memory) > REMEMBERED:
                memory.clear()
            memory[key] = model.element(element, above, trusted)
        fit, link = memory[key]
        fits.append(fit)
        links.append(link)
    fits += [model.block(b.text, b.linked, elements[b.element].tag) for b in page.blocks]
    parents = [e.parent for e in elements] + [b.element for b in page.blocks]
    links += [model.leaf] * len(page.blocks)
    return [m[CONTENT] for m in marginals(parents, fits, links, model.top)[len(elements) :]]


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Model:
    """Potentials from at most about ``sample`` pages with an ``article`` or ``main``, chosen by a digest of the row.

    Only counts by feature and state leave the tasks, and their number is bounded by tags and hashed names.
    """
    labelled = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).filter(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    total = labelled.count()
    place = F.pmod(F.xxhash64(F.lit("labelled"), "id", "html"), F.lit(1 << 30))
    chosen = labelled.filter(place < (1 << 30) * min(1.0, sample / max(1, total)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for html in batch.column("html").to_pylist():
                count_page(read_page(html), zlib.crc32(html.encode("utf-8", "surrogatepass")) % 2 == 0, counts)
        kinds, values, states = zip(*counts, strict=True) if counts else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(states, pa.int32()), pa.array(counts.values(), pa.int64())],
            names=["kind", "value", "state", "n"],
        )

    sums = chosen.select("html").mapInArrow(counted, "kind string, value string, state int, n long")
    found = sums.groupBy("kind", "value", "state").agg(F.sum("n").alias("n")).collect()
    return Model({(r["kind"], r["value"], r["state"]): r["n"] for r in found})


TEXT = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("content", T.DoubleType())]))),
    ]
)
BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("content", pa.float64())]))


def extract_text(
    pages: DataFrame, model: Model, id_col: str = "page_id", html_col: str = "html", blocks: bool = True, carry: bool = False
) -> DataFrame:
    """One row per page: ``page_id, text, n_chars``, all ``blocks`` with their marginals (and ``doc``).

    ``text`` joins the blocks of content in page order; nothing is cut off. Null, empty and blank pages, and pages
    without any content, give the empty text. Repeated pages give the same text each; an empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(TEXT)
    def extracted(htmls: pa.Array) -> pa.Array:
        model, memory, texts, shares = shared.value, {}, [], []
        for html in htmls:
            page = read_page(html.as_py())
            found = content_shares(page, model, memory)
            texts.append("\n".join(b.text for b, share in zip(page.blocks, found, strict=True) if share >= 0.5))
            if blocks:
                shares.append([{"text": b.text, "content": share} for b, share in zip(page.blocks, found, strict=True)])
        parts = pa.array(shares, BLOCKS) if blocks else pa.nulls(len(texts), BLOCKS)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), parts], names=["text", "blocks"])

    shown: list[Column] = [F.col("found.blocks").alias("blocks")] if blocks else []
    return pages.select(F.col(id_col).alias("page_id"), extracted(F.col(html_col)).alias("found"), *doc_column(carry)).select(
        "page_id", F.col("found.text").alias("text"), F.char_length("found.text").cast("long").alias("n_chars"), *shown, *(["doc"] if carry else [])
    )


def main_text(pages: DataFrame, **columns) -> DataFrame:
    """``extract_text`` with potentials learned from the same pages."""
    return extract_text(pages, learn(pages), **columns)
