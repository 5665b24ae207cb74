"""Web pages cut into chunks that keep the page's title and whole paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.markup import HEADINGS, Page, read_page

#: Parts of a page that are no text of it.
ASIDE = frozenset(("nav", "aside", "footer", "form", "head", "menu"))
#: Characters of chunks that a Python task holds before it hands them on.
HELD_CHARS = 1 << 20


def page_paragraphs(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", without: frozenset[str] = frozenset()
) -> DataFrame:
    """``page_id, position, title, heading, tag, text``: the blocks of text of every page, in order.

    A block is the text between two boundaries of block elements, with single blanks; ``tag`` is the
    element it is in, ``heading`` the text of the last heading up to it. Blocks inside elements named in
    ``without`` are left out, before positions are given. A null or empty page has no rows. Pages are read from
    front to back in one pass, whatever their size, and rows of a page leave as they are found.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in range(batch.num_rows):
                page = read_page(batch.column(1)[number].as_py())
                outside = [True] * len(page.elements)
                for at, element in enumerate(page.elements[1:], 1):
                    outside[at] = outside[element.parent] and element.tag not in without
                heading, rows = None, []
                for block in page.blocks:
                    if not outside[block.element]:
                        continue
                    tag = page.elements[block.element].tag
                    heading = block.text if tag in HEADINGS else heading
                    rows.append((len(rows), page.title or None, heading, tag, block.text))
                for start in range(0, len(rows), 10_000):
                    columns = zip(*rows[start : start + 10_000], strict=True)
                    kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
                    arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
                    ids = batch.column(0).take(pa.array([number] * len(arrays[0])))
                    yield pa.RecordBatch.from_arrays([ids, *arrays], names=["page_id", "position", "title", "heading", "tag", "text"])

    return pages.select(id_col, html_col).mapInArrow(
        split, f"page_id {kind}, position int, title string, heading string, tag string, text string"
    )


def _chunks(page: Page, limit: int, without: frozenset[str]) -> Iterator[tuple]:
    """``chunk, title, heading, paragraphs, text`` of a page; a chunk leaves as the next one begins."""
    outside = [True] * len(page.elements)
    for at, element in enumerate(page.elements[1:], 1):
        outside[at] = outside[element.parent] and element.tag not in without
    heading, offset, chunk, first_heading, texts = None, 0, 0, None, []
    for block in page.blocks:
        if not outside[block.element]:
            continue
        heading = block.text if page.elements[block.element].tag in HEADINGS else heading
        if texts and offset // limit != chunk:
            yield chunk, page.title or None, first_heading, len(texts), "\n".join(texts)
            texts = []
        if not texts:
            chunk, first_heading = offset // limit, heading
        texts.append(block.text)
        offset += len(block.text) + 1
    if texts:
        yield chunk, page.title or None, first_heading, len(texts), "\n".join(texts)


def page_chunks(
    pages: DataFrame, limit: int, id_col: str = "page_id", html_col: str = "html", without: frozenset[str] = ASIDE
) -> DataFrame:
    """``page_id, chunk, title, heading, paragraphs, text``: whole paragraphs of a page, packed in order.

    A chunk takes the paragraphs that begin in the same ``limit`` characters of the page's text and is
    as long as they are: no paragraph is cut. ``heading`` is the one that its first paragraph stands under, and
    every chunk carries the page's title. Chunks are packed as a page is read and handed on as they fill
    ``HELD_CHARS``, however many pages come at once; nothing is shuffled.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    names = ["page_id", "chunk", "title", "heading", "paragraphs", "text"]

    def as_batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        at, *columns = zip(*rows, strict=True)
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string())
        arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *arrays], names=names)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sources = batch.column(0), batch.column(1)
            rows, held = [], 0
            for number in range(batch.num_rows):
                for row in _chunks(read_page(sources[number].as_py()), limit, without):
                    rows.append((number, *row))
                    held += sum(len(value or "") for value in (row[1], row[2], row[4]))
                    if held >= HELD_CHARS:
                        yield as_batch(ids, rows)
                        rows, held = [], 0
            if rows:
                yield as_batch(ids, rows)

    return pages.select(id_col, html_col).mapInArrow(
        packed, f"page_id {kind}, chunk int, title string, heading string, paragraphs int, text string"
    )


def chunk_key(*columns: str):
    """A chunk's own name, from what names it."""
    return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
