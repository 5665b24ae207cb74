"""Small tables with the cases that every operator has to handle."""

from __future__ import annotations

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Names that operators use inside.
    "row long, `group` string, rest string, size int, hash long, fp long, score string, doc string, kept int, "
    "word string, bytes string, label int, weight double, host string, id long"
)
CLASHES = (7, "g", "r", 1, 2, 3, "s", "d", 4, "w", "b", 1, 0.5, "h", 9)

LONG = "the quick brown fox jumps over " * 4000
TEXTS = [
    (1, "Some Words here, and some more."),
    (2, "some words HERE, and some more."),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b\x0c\r "),
    (6, LONG),
    (7, LONG + "dog"),
    (8, LONG + "cat"),
    (9, LONG.upper()),
    (10, "x" * 70_000),
    (11, "x" * 70_000),
    (12, "Één twee drie vier; ñandú, ÀÉ 中文 字 🙂🙂   nbsp"),
    (13, "één twee drie vier; ñandú, ÀÉ 中文 字 🙂🙂   nbsp"),
    (None, "a row without an id"),
    (None, None),
    (16, "Some words here, and some more."),
    (16, "Some words here, and some more."),  # a repeated row
    (17, "word " * 400),
    (18, "word " * 400),
    (19, "<|endoftext|> inside <|endoftext|>\n\n  two  blanks"),
    (-5, "a negative id"),
]


def documents(spark, texts=None):
    sources = ["b", "a", None, "ä", "", "c"]
    rows = [
        (i, text, "en", sources[n % len(sources)], None if text is None else len(text), *CLASHES)
        for n, (i, text) in enumerate(TEXTS if texts is None else texts)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def all_null(spark):
    return spark.createDataFrame([(None,) * 20] * 4, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [row.asDict() for row in df.collect()]
