"""Phrases whose words occur together, mined by partitions of the corpus (SON).

The corpus is dealt into ``SHARDS`` parts. A phrase that occurs ``support`` times in all occurs
``support / SHARDS`` times in one part at least, so the phrases that reach that share in some part
hold every frequent one, however uneven the parts are. Each part is mined completely at the lowered
support, by digests of phrases, shortest first: a longer phrase is looked at only where the
shorter ones inside it were frequent in some part. The union of what the parts found becomes a
bitmap of fixed size, and one more pass counts every phrase that it lets through, globally and
by the words themselves. Neither a collision of digests nor a full bitmap loses or changes a
count; they cost time only.

Tasks count by numbers of words in chunks of bounded size and pass on sums by phrase, which
combine again before and after the shuffle, so a very common word, line or passage is a few rows.
Digests travel as sorted arrays, one for each bucket of their values, and are added up bucket by bucket.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import discard, lookup, stored, text_bytes
from colloquy.llm.ranks import positions

#: Parts of the corpus that are mined by themselves.
SHARDS = 3
#: Bits of the bitmap of candidates: 16 MB, whatever the corpus.
BITS = 27
#: Words counted at once, distinct words remembered, and bytes of a text taken at once.
CHUNK, REMEMBERED, SEGMENT = 1 << 20, 150_000, 1 << 20
#: Bits of a word's number: a chunk remembers fewer words, with those of one more segment.
NUMBER = 21
#: The language of rows without one.
NO_LANG = "und"
#: Ends of pieces become full stops, other separators blanks; a full stop is no word then.
PIECES = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def segments(text: bytes) -> Iterator[list[bytes]]:
    """Words of a whole text, with a full stop at every end of a piece, about ``SEGMENT`` bytes at a time."""
    text = text.translate(PIECES)
    start = 0
    while start < len(text):
        end = len(text)
        if end - start > SEGMENT:
            # Cut at an end of a piece: no phrase crosses it.
            end = text.rfind(b".", start, start + SEGMENT) + 1 or text.find(b".", start + SEGMENT) + 1 or len(text)
        words = text[start:end].replace(b".", b" . ").split(b" ")
        yield [word for word in words if word]
        start = end


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A digest of two digests, by a multiplication, a shift and another multiplication."""
    both = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + np.uint64(0x632BE59BD9B4E019))
    both ^= both >> np.uint64(29)
    both *= np.uint64(0xBF58476D1CE4E5B9)
    return both ^ (both >> np.uint64(32))


class Known(dict):
    """Numbers of the words of a language, given as they come; 0 stands between pieces."""

    def __init__(self, words: Words, lang: str):
        super().__init__({b".": 0})
        self.words, self.lang, self.seed = words, lang, xxhash.xxh32_intdigest(lang)

    def __missing__(self, word: bytes) -> int:
        words = self.words
        self[word] = number = len(words.words)
        words.words.append(word)
        words.langs.append(self.lang)
        words.digests.append(xxhash.xxh64_intdigest(word, self.seed))
        return number


@dataclass
class Words:
    """The words of a chunk as numbers, by shard."""

    known: dict[str, Known] = field(default_factory=dict)
    words: list[bytes] = field(default_factory=lambda: [b""])
    langs: list[str | None] = field(default_factory=lambda: [None])
    digests: array = field(default_factory=lambda: array("Q", [0]))
    parts: dict[int, list[np.ndarray]] = field(default_factory=dict)
    held: int = 0

    def add(self, shard: int, lang: str, words: list[bytes]) -> None:
        if lang not in self.known:
            self.known[lang] = Known(self, lang)
        ids = np.zeros(len(words) + 1, np.int32)
        ids[:-1] = np.fromiter(map(self.known[lang].__getitem__, words), np.int32, len(words))
        self.parts.setdefault(shard, []).append(ids)
        self.held += len(ids)

    def full(self) -> bool:
        return self.held > CHUNK or len(self.words) > REMEMBERED

    def phrases(self, rows: np.ndarray) -> tuple[list[str], list[bytes]]:
        """Language and text of each row of word numbers."""
        words, langs = self.words, self.langs
        return [langs[i] for i in rows[:, 0].tolist()], [b" ".join([words[i] for i in row]) for row in rows.tolist()]


@dataclass(frozen=True)
class Candidates:
    """A bitmap of digests; without one, everything passes."""

    bits: np.ndarray | None

    def has(self, digests: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(digests), bool)
        place = digests >> np.uint64(64 - BITS)
        return (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Where phrases of ``size`` words begin."""
    whole = ids[: len(ids) - size + 1] > 0
    for i in range(1, size):
        whole &= ids[i : len(ids) - size + 1 + i] > 0
    return np.flatnonzero(whole).astype(np.int32)


def phrase_digests(digests: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    found = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), 1 << 16):
        some = starts[a : a + (1 << 16)]
        part = digests[some]
        for i in range(1, size):
            part = mixed(part, digests[some + i])
        found[a : a + len(some)] = part
    return found


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs; sorts the array it is given."""
    values.sort()
    begin = np.flatnonzero(np.r_[len(values) > 0, values[1:] != values[:-1]]).astype(np.int32)
    return values[begin], np.diff(begin, append=np.int32(len(values)))


def exact_parts(ids: np.ndarray, starts: np.ndarray, size: int, rows: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of word numbers of the distinct phrases at ``starts``, and how often each occurs; some rows at a time."""
    if size == 1:
        counts = np.bincount(ids[starts])
        found = np.flatnonzero(counts)
        counts = counts[found]
    elif size * NUMBER < 64:
        key = ids[starts].astype(np.int64)
        for i in range(1, size):
            key <<= NUMBER
            key |= ids[starts + i]
        found, counts = runs(key)
        del key
    else:
        found, counts = np.unique(np.stack([ids[starts + i] for i in range(size)], axis=1), axis=0, return_counts=True)
    for a in range(0, len(found), rows):
        some = found[a : a + rows]
        if some.ndim == 1:
            # A phrase is one number: its words are taken apart again only as it is handed on.
            some = some[:, None] >> NUMBER * np.arange(size - 1, -1, -1) & (1 << NUMBER) - 1
        yield some, counts[a : a + rows]


def exact_counts(ids: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same at once."""
    found, counts = zip((np.empty((0, size), np.int64), np.empty(0, np.int64)), *exact_parts(ids, starts, size), strict=True)
    return np.concatenate(found), np.concatenate(counts)


def _parts(rows: DataFrame, count: int, mine: int, shared, buckets: int) -> DataFrame:
    """Stored sums of chunks: ``lang, phrase, n`` exact, and ``bucket, shard, grams, counts`` of mined digests.

    Counts the phrases of ``count`` words that ``shared`` candidates hold (words: all), and mines
    those of ``mine`` words (0: none) whose inner phrases of ``count`` words they all hold.
    """
    names = ["lang", "phrase", "n", "bucket", "shard", "grams", "counts"]
    kinds = [pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def batch_of(*columns: list, nulls: int) -> pa.RecordBatch:
        size = len(columns[0])
        given = [pa.nulls(size, k) for k in kinds[:nulls]] + [pa.array(c, k) for c, k in zip(columns, kinds[nulls:], strict=False)]
        return pa.RecordBatch.from_arrays(given + [pa.nulls(size, k) for k in kinds[len(given) :]], names=names)

    def flush(words: Words, candidates: Candidates) -> Iterator[pa.RecordBatch]:
        numbers = np.array(words.digests, np.uint64)
        # A shard after the other, and no array longer than it is needed: their sum is what a worker takes.
        for shard in list(words.parts):
            ids = np.concatenate(words.parts.pop(shard))
            digests = numbers[ids]
            starts = windows(ids, count)
            if candidates.bits is not None:
                starts = starts[candidates.has(phrase_digests(digests, starts, count))]
            for found, n in exact_parts(ids, starts, count):
                yield batch_of(*words.phrases(found), n, nulls=0)
            if mine:
                yield from mined(shard, ids, digests, starts)

    def mined(shard: int, ids: np.ndarray, digests: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        fits = np.zeros(len(ids), bool)
        fits[starts] = True
        longer = windows(ids, mine)
        for i in range(mine - count + 1):
            longer = longer[fits[longer + i]]
        grams, n = runs(phrase_digests(digests, longer, mine))
        edges = np.searchsorted(grams, np.array([-(-(b << 32) // buckets) << 32 for b in range(1, buckets)], np.uint64))
        edges = [0, *edges.tolist(), len(grams)]
        spans = [(b, i, j) for b, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if i < j]
        for a in range(0, len(spans), 256):
            some = spans[a : a + 256]
            yield batch_of(
                [b for b, _, _ in some], [shard] * len(some), [grams[i:j].tobytes() for _, i, j in some],
                [n[i:j].astype("<u4").tobytes() for _, i, j in some], nulls=3,
            )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        candidates, words = shared.value, Words()
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("lang", "shard"))
            for lang, shard, text in zip(*columns, batch.column("bytes"), strict=True):
                for some in segments(text.as_py()):
                    words.add(shard, lang, some)
                    if words.full():
                        yield from flush(words, candidates)
                        words = Words()
        yield from flush(words, candidates)

    return stored(
        rows.mapInArrow(counted, "lang string, phrase binary, n long, bucket int, shard int, grams binary, counts binary"),
        "phrases-parts",
    )


def _often(parts: DataFrame, lowered: int) -> DataFrame:
    """Stored digests that some shard holds ``lowered`` times or more."""

    def merged(rows: pa.Table) -> pa.Table:
        grams = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in rows["grams"]])
        counts = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in rows["counts"]])
        order = np.argsort(grams)
        grams = grams[order]
        begin = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        sums = np.add.reduceat(counts[order].astype(np.int64), begin)
        return pa.table({"gram": pa.array(grams[begin][sums >= lowered].view(np.int64), pa.int64())})

    mined = parts.filter("grams IS NOT NULL").select("bucket", "shard", "grams", "counts")
    return stored(mined.groupBy("bucket", "shard").applyInArrow(merged, "gram long"), "phrases-grams")


def _bitmap(grams: DataFrame) -> Candidates:
    """The union of what the shards found, as a bitmap: 2 ** BITS bits pass the driver at most."""
    place = f"shiftrightunsigned(gram, {64 - BITS})"
    words = grams.selectExpr(
        f"shiftright({place}, 6) AS word", f"shiftleft(1L, cast({place} % 64 AS int)) AS bit"
    )
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Candidates(bits)


def phrase_counts(docs: DataFrame, support: int, longest: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``lang, phrase, size, n``: all words, and all phrases of 2 to ``longest`` words with ``support``; exact."""
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"),
        F.pmod(F.xxhash64(F.lit("shard"), id_col), F.lit(SHARDS)).cast("int").alias("shard"),
        text_bytes(text_col).alias("bytes"),
    )
    # A bucket holds its part of every task's digests: more ranges for more data, as for any shuffle.
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    candidates, total = Candidates(None), None
    for size in range(1, longest + 1):
        more = size + 1 if size < longest else 0
        parts = _parts(rows, size, more, spark.sparkContext.broadcast(candidates), buckets)
        sums = parts.filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        exact = stored(
            sums.filter(F.lit(size == 1) | (F.col("n") >= support)).select(
                "lang", F.col("phrase").cast("string").alias("phrase"), F.lit(size).alias("size"), "n"
            ),
            "phrases-exact",
        )
        total = exact if total is None else total.unionByName(exact)
        if more:
            candidates = _bitmap(_often(parts, -(-support // SHARDS)))
        discard(parts)
    return total


def _words(begin: Column | int, many: Column | int) -> Column:
    return F.array_join(F.slice("words", begin, many), " ")


def _inner(size: int) -> Column:
    """One row for every place of ``size`` words in a phrase."""
    places = F.sequence(F.lit(1), F.col("size") - size + 1)
    return F.explode(F.transform(places, lambda place: _words(place, size))).alias("phrase")


def collocations(
    docs: DataFrame,
    support: int = 10,
    longest: int = 3,
    first: int = 2000,
    covered: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the ``first`` phrases of each language.

    A-Z are lower-cased. Pieces end at ``. , ; : ! ?`` and line ends, words at blanks and tabs; phrases are
    2 to ``longest`` words of one piece that occur ``support`` times. ``a`` counts the phrase, ``l`` and
    ``r`` the two parts of the cut with the lowest ``score``, a million ``a * a / (l * r)`` rounded down (ties: the
    earliest cut), ``n`` all words of the language. A phrase goes if a longer one with the support
    holds its words and occurs at least ``covered`` percent as often. Ranks are by score, count and phrase.

    Null texts are empty and null languages ``und``; repeated rows count as often as they occur, and ids
    only deal rows out, so null and repeated ones don't matter. Empty tables give empty results.
    """
    counts = phrase_counts(docs, support, longest, id_col, text_col, lang_col)
    totals = stored(counts.filter("size = 1").groupBy("lang").agg(F.sum("n").alias("all_words")), "phrases-totals")
    found = counts.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    # What a longer phrase covers: all of its inner phrases of each shorter size.
    inner = [found.filter(F.col("size") > size).select("lang", F.col("a").alias("outer"), _inner(size)) for size in range(2, longest)]
    kept = found
    for part in inner:
        kept = kept.join(part.groupBy("lang", "phrase").agg(F.max("outer").alias("outer")), ["lang", "phrase"], "left")
        kept = kept.filter(F.col("outer").isNull() | (100 * F.col("outer") < covered * F.col("a"))).drop("outer")
    cuts = kept.select(
        "lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    ).select("lang", "phrase", "a", "k", _words(1, F.col("k")).alias("left"), _words(F.col("k") + 1, F.size("words")).alias("right"))
    # All parts of a frequent phrase are frequent, so only such are looked up.
    often = counts.filter(F.col("n") >= support)
    left = often.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = often.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    wide = "decimal(38,0)"
    score = F.expr(f"(1000000BD * cast(cast(a AS decimal(19,0)) * a AS {wide})) div cast(cast(l AS decimal(19,0)) * r AS {wide})")
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", score.cast("long"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    ready = stored(lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "phrases-scored")
    ranked = positions(ready, "lang", [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()])
    return ranked.filter(F.col("position") < first).join(lookup(totals), "lang").select(
        "lang", (F.col("position") + 1).alias("rank"), "phrase", "a", "l", "r", F.col("all_words").alias("n"), "score"
    )
