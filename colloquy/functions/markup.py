"""HTML as blocks of text under a tree of block elements, read in one pass.

The reader walks the markup once from front to back, with a stack of open block elements. It
accepts whatever browsers do: elements that are never closed, end tags without a start, broken
attributes, comments and scripts without an end. Text of scripts, styles and form fields is not shown and
so is no text here. Every step moves forward, so a page of any size and kind takes time in
proportion to its length.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Elements as the HTML standard sorts them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements whose content is text up to their end tag, and is not shown.
HIDDEN = frozenset(("iframe", "noembed", "noframes", "noscript", "script", "select", "style", "svg", "template", "textarea", "title", "xmp"))
#: Start tags that close elements of their own kind left open above them.
CLOSED_BY = {
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "td": frozenset(("td", "th")),
    "th": frozenset(("td", "th")),
    "tr": frozenset(("td", "th", "tr", "caption")),
    "tbody": frozenset(("td", "th", "tr", "thead", "tbody", "caption")),
    "thead": frozenset(("td", "th", "tr", "tbody", "caption")),
    "tfoot": frozenset(("td", "th", "tr", "thead", "tbody", "caption")),
    "option": frozenset(("option",)),
    "optgroup": frozenset(("option", "optgroup")),
    "body": frozenset(("head",)),
}
END_OF = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in HIDDEN}
NO_CONTENT = frozenset(("hr",))

NAME = re.compile(r"[A-Za-z][^\s/>]*")
VALUE = re.compile(r"=\s*([\"'])")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


@dataclass(slots=True)
class Element:
    """A block element: its place in the list of all, its parent's, and its start tag."""

    parent: int
    tag: str
    attributes: str = ""

    def attribute(self, *names: str) -> str:
        found = [a or b or c for name, a, b, c in ATTRIBUTE.findall(self.attributes) if name.lower() in names]
        return html.unescape(" ".join(found))


@dataclass(slots=True)
class Block:
    """Text that stands together: the element it is in, and how much of it is in links."""

    element: int
    text: str
    linked: int


@dataclass
class Page:
    title: str = ""
    elements: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


class _Reader:
    def __init__(self, source: str):
        self.source = source
        self.page = Page(elements=[Element(-1, "#page")])
        self.stack = [0]
        self.open: dict[str, int] = {}
        self.text: list[str] = []
        self.in_link, self.linked = False, 0
        self.quoted = True
        self.last = {quote: source.rfind(quote) for quote in "\"'>"}

    def read(self) -> Page:
        source, at = self.source, 0
        while True:
            tag = source.find("<", at)
            if tag < 0:
                self.add(source[at:])
                break
            if tag > at:
                self.add(source[at:tag])
            at = self.markup(tag)
        self.flush()
        return self.page

    def markup(self, at: int) -> int:
        """Takes what begins with ``<`` and returns where it ends."""
        source, size = self.source, len(self.source)
        if source.startswith("<!--", at):
            if source.startswith((">", "->"), at + 4):  # an empty comment
                return source.index(">", at) + 1
            end = source.find("-->", at + 4)
            return size if end < 0 else end + 3
        following = source[at + 1 : at + 3]
        if following[:1] in ("!", "?") or following[:1] == "/" and not following[1:].isalpha():
            end = source.find(">", at)
            return size if end < 0 else end + 1
        closing = following[:1] == "/"
        name = NAME.match(source, at + 1 + closing)
        if name is None:
            self.add("<")
            return at + 1
        end = self.tag_end(name.end())
        tag = name[0].lower()
        if closing:
            self.end(tag)
            return min(end + 1, size)
        attributes = source[name.end() : end]
        if tag in HIDDEN:
            return self.hidden(tag, min(end + 1, size))
        if tag in BLOCKS:
            self.start(tag, attributes)
        elif tag == "a":
            self.in_link = True
        elif tag in ("br", "wbr", "img", "input", "button", "video", "audio", "canvas", "object"):
            self.text.append("" if tag == "wbr" else " ")
        return min(end + 1, size)

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag, past those in quotes; the end of the page if there is none.

        Where quotes leave a tag without an end, quotes count for nothing from there on.
        """
        source = self.source
        first = end = source.find(">", at)
        while self.quoted and 0 <= end:
            # A quote opens a value only behind an equals sign.
            value = VALUE.search(source, at, end)
            if value is None:
                return end
            quote = value[1]
            if value.end() > self.last[quote]:
                return end
            at = source.find(quote, value.end()) + 1
            if at > end:
                end = source.find(">", at) if at <= self.last[">"] else -1
        if end < 0 <= first:
            self.quoted = False
        return len(source) if first < 0 else first

    def hidden(self, tag: str, at: int) -> int:
        """Skips the content of an element that is not shown; keeps the first title."""
        end = END_OF[tag].search(self.source, at)
        stop = len(self.source) if end is None else end.start()
        if tag == "title" and not self.page.title:
            self.page.title = tidy(html.unescape(self.source[at:stop]))
        if end is None:
            return stop
        close = self.source.find(">", stop)
        return len(self.source) if close < 0 else close + 1

    def add(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.text.append(text)
        if self.in_link:
            self.linked += len(text)

    def flush(self) -> None:
        if self.text:
            text = tidy("".join(self.text))
            if text:
                self.page.blocks.append(Block(self.stack[-1], text, min(self.linked, len(text))))
            self.text = []
        self.linked = 0

    def start(self, tag: str, attributes: str) -> None:
        self.flush()
        if self.page.elements[self.stack[-1]].tag == "p":
            self.pop()
        closes = CLOSED_BY.get(tag, ())
        while self.page.elements[self.stack[-1]].tag in closes:
            self.pop()
        if tag in HEADINGS and self.page.elements[self.stack[-1]].tag in HEADINGS:
            self.pop()
        self.page.elements.append(Element(self.stack[-1], tag, attributes))
        if tag not in NO_CONTENT:
            self.stack.append(len(self.page.elements) - 1)
            self.open[tag] = self.open.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        elif tag in BLOCKS:
            self.flush()
            # The end of the body is that of the page: what follows it still belongs to the body.
            if self.open.get(tag) and tag not in ("body", "html"):
                while self.pop() != tag:
                    pass

    def pop(self) -> str:
        tag = self.page.elements[self.stack.pop()].tag
        self.open[tag] -= 1
        self.in_link = False
        return tag


def tidy(text: str) -> str:
    """White space as single blanks, none at the ends."""
    return " ".join(text.split())


def read_page(source: str | None) -> Page:
    """Title, block elements and blocks of text of a page, in order; null is an empty page."""
    return _Reader(source or "").read()
