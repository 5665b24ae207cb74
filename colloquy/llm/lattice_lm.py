"""Language-model scores: marginal probabilities over subword lattices.

The pieces of an existing vocabulary span a lattice over each word, with the mark of a word's start before
it; no piece crosses words. A document is pieces drawn one after the other up to an end, and its
probability the sum over all segmentations of its whole text. Words share no piece, so that sum is the
product of the words' own sums, each by a forward recursion in log space, and of the end.

The vocabulary's own scores segment the learned words once; from there on, rounds of expected counts
over the same lattices, weighted by how often a word was learned, give each piece its probability
(expectation and maximization). Counts cover all learned documents.

Every distinct word is looked at once a round, wherever it occurs. The most frequent words are
broadcast with their scores, a bounded number; the others of each document meet theirs in a join,
in which no word is frequent.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import remainder, stored, text_bytes

#: Words broadcast, and entries a task holds at once.
HEAD, HELD = 100_000, 300_000
#: Rounds of expected counts, and the count of every piece beside them.
ROUNDS, FLOOR = 2, 0.01
#: Characters up to which the probability of a word cannot underflow.
SHORT = 24
#: Linear sums below this one are left to logarithms.
TINY = 1e-250
#: The empty word stands for the end of a text.
END = b""
#: The vocabulary's mark of a word's start.
START = "▁"


def count_words(rows: DataFrame) -> DataFrame:
    """Stored ``word, train, every``: counts in learned and in all documents; the end of a text is a word."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            for out, counts in enumerate(held):
                words = list(counts)
                for start in range(0, len(words), 50_000):
                    part = words[start : start + 50_000]
                    every = pa.array([counts[w] for w in part], pa.int64())
                    train = pa.array([0] * len(part), pa.int64()) if out else every
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), train, every], names=["word", "train", "every"])
                counts.clear()

        for batch in batches:
            for out, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                into = held[out]
                into.update(text.as_py().lower().split())
                into[END] += 1
                if len(held[0]) + len(held[1]) > HELD:
                    yield from flush()
        yield from flush()

    parts = rows.select("held_out", "bytes").mapInArrow(counted, "word binary, train long, every long")
    return stored(parts.groupBy("word").agg(F.sum("train").alias("train"), F.sum("every").alias("every")), "lm-words")


# The lattice.


@functools.lru_cache(maxsize=2)
def processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


@functools.lru_cache(maxsize=2)
def vocabulary(model: bytes) -> tuple[dict[str, int | None], list[int]]:
    """Ids of the pieces and None for their other prefixes; ids of the 256 bytes."""
    pieces = processor(model)
    table: dict[str, int | None] = {}
    ids = [pieces.piece_to_id(f"<0x{byte:02X}>") for byte in range(256)]
    for number in range(pieces.get_piece_size()):
        if pieces.is_control(number) or pieces.is_unknown(number) or pieces.is_byte(number):
            continue
        piece = pieces.id_to_piece(number)
        for end in range(1, len(piece)):
            table.setdefault(piece[:end], None)
        table[piece] = number
    return table, ids


def lattice(word: bytes, table: dict[str, int | None], byte_ids: list[int]) -> tuple[int, list[tuple[int, int, tuple[int, ...]]]]:
    """Length and arcs (begin, end, pieces), by begin. A character without a piece is its bytes."""
    text = START + word.decode("utf-8", "replace")
    size, arcs = len(text), []
    for begin in range(size):
        single = False
        for end in range(begin + 1, size + 1):
            piece = table.get(text[begin:end], -1)
            if piece == -1:
                break
            if piece is not None:
                arcs.append((begin, end, (piece,)))
                single = single or end == begin + 1
        if not single:
            arcs.append((begin, begin + 1, tuple(byte_ids[byte] for byte in text[begin].encode())))
    return size, arcs


def _log_sum(terms: list[float]) -> float:
    if len(terms) == 1:
        return terms[0]
    high = max(terms)
    return high + math.log(sum([math.exp(term - high) for term in terms]))


def forward(size: int, arcs, logs: list[float]) -> list[float]:
    """Log probability of every prefix, summed over its segmentations."""
    terms: list[list[float]] = [[] for _ in range(size + 1)]
    terms[0].append(0.0)
    sums = [0.0] * (size + 1)
    at = 0
    for begin, end, pieces in arcs:
        if begin > at:
            at = begin
            sums[at] = _log_sum(terms[at])
        terms[end].append(sums[begin] + (logs[pieces[0]] if len(pieces) == 1 else sum(logs[p] for p in pieces)))
    sums[size] = _log_sum(terms[size])
    return sums


def marginal(word: bytes, table, byte_ids: list[int], logs: list[float]) -> float:
    """Natural logarithm of a word's probability over all segmentations.

    ``forward`` over ``lattice`` without keeping the arcs.
    """
    text = START + word.decode("utf-8", "replace")
    size, find = len(text), table.get
    terms: list[list[float]] = [[] for _ in range(size + 1)]
    terms[0].append(0.0)
    for begin in range(size):
        here = terms[begin]
        before = here[0] if len(here) == 1 else _log_sum(here)
        single = False
        for end in range(begin + 1, size + 1):
            piece = find(text[begin:end], -1)
            if piece is None:
                continue
            if piece < 0:
                break
            terms[end].append(before + logs[piece])
            single = single or end == begin + 1
        if not single:
            terms[begin + 1].append(before + sum([logs[byte_ids[byte]] for byte in text[begin].encode()]))
    return _log_sum(terms[size])


def expected_pieces(
    word: bytes, table, byte_ids: list[int], logs: list[float], rates: list[float], into: list[float], times: float = 1.0
) -> None:
    """Adds ``times`` the expected count of every piece of a word, by forward and backward sums.

    Words short enough not to underflow are summed without logarithms; ``rates`` are those of ``logs``.
    """
    text = START + word.decode("utf-8", "replace")
    size, find = len(text), table.get
    if size <= SHORT and _expected_short(text, size, find, rates, into, times):
        return
    size, arcs = lattice(word, table, byte_ids)
    ahead = forward(size, arcs, logs)
    back: list[list[float]] = [[] for _ in range(size + 1)]
    back[size].append(0.0)
    sums: list[float | None] = [None] * (size + 1)
    for begin, end, pieces in reversed(arcs):
        if sums[end] is None:
            sums[end] = _log_sum(back[end])
        cost = sum([logs[p] for p in pieces])
        back[begin].append(sums[end] + cost)
        share = times * math.exp(ahead[begin] + cost + sums[end] - ahead[size])
        for piece in pieces:
            into[piece] += share


def _expected_short(text: str, size: int, find, rates: list[float], into: list[float], times: float) -> bool:
    """The same without logarithms; False if a character has no piece or the sum vanishes."""
    ahead, arcs = [0.0] * (size + 1), []
    ahead[0] = 1.0
    for begin in range(size):
        before, single = ahead[begin], False
        for end in range(begin + 1, size + 1):
            piece = find(text[begin:end], -1)
            if piece is None:
                continue
            if piece < 0:
                break
            term = before * rates[piece]
            ahead[end] += term
            arcs.append((begin, end, piece, term))
            single = single or end == begin + 1
        if not single:
            return False
    if not ahead[size]:
        return False
    behind = [0.0] * (size + 1)
    behind[size] = 1 / ahead[size]
    arcs.reverse()
    for begin, end, piece, term in arcs:
        after = behind[end]
        into[piece] += times * term * after
        behind[begin] += rates[piece] * after
    return True


# Lattices of many words at once.


@dataclass(frozen=True)
class Trie:
    """The vocabulary's pieces by characters: sorted keys of a node and a character, and for each the next node and its piece or -1."""

    keys: np.ndarray
    nodes: np.ndarray
    pieces: np.ndarray


@functools.lru_cache(maxsize=2)
def trie(model: bytes) -> Trie:
    table, _ = vocabulary(model)
    numbers = {"": 0} | {prefix: number for number, prefix in enumerate(table, 1)}
    found = sorted((numbers[prefix[:-1]] << 21 | ord(prefix[-1]), numbers[prefix], -1 if piece is None else piece) for prefix, piece in table.items())
    keys, nodes, pieces = np.array(found, np.int64).reshape(-1, 3).T.copy()
    return Trie(keys, nodes, pieces)


class Lattices:
    """The arcs of words of up to ``SHORT`` characters, and linear sums over their segmentations.

    The characters of all words stand in one array, each word before a zero, so an arc leads from a
    place to a place. Arcs are in groups of one distance from the word's start and one length: within a
    group each place occurs once. ``fits`` marks the words in which every character has a piece.
    """

    def __init__(self, texts: list[str], model: bytes):
        pieces = trie(model)
        chars = np.frombuffer("".join([text + "\0" for text in texts]).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.places = len(chars)
        begins, lengths, found = [], [], []
        active, node, length = np.flatnonzero(chars), 0, 0
        alone = chars == 0
        while len(active) and len(pieces.keys):
            key = node << 21 | chars[active + length]
            at = np.minimum(np.searchsorted(pieces.keys, key), len(pieces.keys) - 1)
            here = pieces.keys[at] == key
            active, at, length = active[here], at[here], length + 1
            node, piece = pieces.nodes[at], pieces.pieces[at]
            whole = piece >= 0
            begins.append(active[whole])
            lengths.append(np.full(len(begins[-1]), length))
            found.append(piece[whole])
            if length == 1:
                alone[begins[-1]] = True
        none = [np.empty(0, np.int64)]
        begin, size, piece = (np.concatenate(none + column) for column in (begins, lengths, found))
        group = (begin - np.repeat(self.starts, sizes + 1)[begin]) * (length + 1) + size
        order = np.argsort(group, kind="stable")
        self.begin, self.piece = begin[order], piece[order]
        self.to = self.begin + size[order]
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        self.groups = [slice(i, j) for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)], strict=True)]
        self.fits = np.logical_and.reduceat(alone, self.starts) if len(texts) else np.zeros(0, bool)

    def ahead(self, rates: np.ndarray) -> np.ndarray:
        """Sums over the segmentations of what is before each place."""
        sums, rate = np.zeros(self.places), rates[self.piece]
        sums[self.starts] = 1
        for some in self.groups:
            sums[self.to[some]] += sums[self.begin[some]] * rate[some]
        return sums

    def expected(self, rates: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected counts of the pieces, each word ``times`` over, and the words that are summed."""
        ahead, behind, rate = self.ahead(rates), np.zeros(self.places), rates[self.piece]
        whole = ahead[self.ends]
        summed = self.fits & (whole > TINY)
        behind[self.ends[summed]] = times[summed] / whole[summed]
        for some in reversed(self.groups):
            behind[self.begin[some]] += rate[some] * behind[self.to[some]]
        return np.bincount(self.piece, ahead[self.begin] * rate * behind[self.to], len(rates)), summed

    def logs(self, rates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural logarithms of the words' probabilities, and the words that are summed."""
        whole = self.ahead(rates)[self.ends]
        summed = self.fits & (whole > TINY)
        return np.log(np.where(summed, whole, 1)), summed


def _lattices(words: list[bytes], model: bytes) -> tuple[np.ndarray, Lattices]:
    """Places of the words that are short enough, and their lattices."""
    texts = [START + word.decode("utf-8", "replace") for word in words]
    short = [place for place, text in enumerate(texts) if len(text) <= SHORT and "\0" not in text]
    return np.array(short, np.int64), Lattices([texts[place] for place in short], model)


def expected_counts(words: list[bytes], times: np.ndarray, logs: np.ndarray, model: bytes) -> np.ndarray:
    """Expected counts of all pieces; words that can't be summed linearly are summed one by one."""
    rates = np.exp(logs)
    rest = np.ones(len(words), bool)
    short, lattices = _lattices(words, model)
    counts, summed = lattices.expected(rates, times[short])
    rest[short[summed]] = False
    if rest.any():
        table, byte_ids = vocabulary(model)
        into, logs, rates = [0.0] * len(rates), logs.tolist(), rates.tolist()
        for place in np.flatnonzero(rest).tolist():
            expected_pieces(words[place], table, byte_ids, logs, rates, into, int(times[place]))
        counts = counts + np.array(into)
    return counts


def marginals(words: list[bytes], logs: np.ndarray, model: bytes) -> np.ndarray:
    """``marginal`` of every word; words that can't be summed linearly are summed one by one."""
    out, rest = np.zeros(len(words)), np.ones(len(words), bool)
    short, lattices = _lattices(words, model)
    found, summed = lattices.logs(np.exp(logs))
    out[short[summed]] = found[summed]
    rest[short[summed]] = False
    if rest.any():
        table, byte_ids = vocabulary(model)
        logs = logs.tolist()
        for place in np.flatnonzero(rest).tolist():
            out[place] = marginal(words[place], table, byte_ids, logs)
    return out


def _piece_logs(counts: np.ndarray, ends: int) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces and of the end, which are drawn from together."""
    counts = counts + FLOOR
    total = counts.sum() + ends + FLOOR
    return np.log(counts / total), math.log((ends + FLOOR) / total)


@dataclass(frozen=True)
class Totals:
    """Tokens, distinct words and documents learned."""

    tokens: int
    types: int
    docs: int


def learn_pieces(words: DataFrame, model: bytes, totals: Totals) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces and of the end of a text, from all learned words."""
    spark = words.sparkSession
    size = processor(model).get_piece_size()
    content = spark.sparkContext.broadcast(model)
    logs, end = None, 0.0
    for _ in range(ROUNDS + 1):
        shared = None if logs is None else spark.sparkContext.broadcast(logs)

        def counted(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found = np.zeros(size)
            for batch in batches:
                texts, times = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                if shared is None:
                    decoded = [text.decode("utf-8", "replace") for text in texts]
                    ids = processor(content.value).encode(decoded, num_threads=1)
                    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
                    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64, lengths.sum())
                    found += np.bincount(flat, np.repeat(times, lengths), size)
                else:
                    found += expected_counts(texts, times, shared.value, content.value)
            pieces = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int32()), pa.array(found[pieces], pa.float64())], names=["piece", "n"])

        parts = words.filter("train > 0 AND word <> X''").select("word", "train")
        found = parts.mapInArrow(counted, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()  # pieces at most
        counts = np.zeros(size)
        counts[found["piece"].to_numpy()] = found["n"].to_numpy()
        # Sums arrive in any order: fewer digits make reruns agree.
        logs, end = _piece_logs(np.round(counts, 3), totals.docs)
        logs = np.round(logs, 9)
    return logs, end


def word_scores(words: DataFrame, totals: Totals, logs: np.ndarray, end: float, model: bytes) -> DataFrame:
    """Stored ``word, every, known, base, score``; logarithms to base 10."""
    content = words.sparkSession.sparkContext.broadcast((model, logs, end, totals))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, logs, end, totals = content.value
        for batch in batches:
            train, words = batch.column(1).to_numpy(), batch.column(0).to_pylist()
            score = np.where([word == END for word in words], end, marginals(words, logs, model))
            base = np.log10((train + 0.5) / (totals.tokens + 0.5 * (totals.types + 1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(train > 0), pa.array(base), pa.array(score / math.log(10), pa.float64())],
                names=["word", "every", "known", "base", "score"],
            )

    return stored(
        words.select("word", "train", "every").mapInArrow(scored, "word binary, every long, known boolean, base double, score double"),
        "lm-word-scores",
    )


class Head:
    """The broadcast part of the word scores, for one worker."""

    def __init__(self, content: bytes):
        table = pa.ipc.open_stream(content).read_all()
        self.rows = {word: place for place, word in enumerate(table["word"].to_pylist())}
        self.score, self.base, self.known = (table[name].to_numpy() for name in ("score", "base", "known"))


@functools.lru_cache(maxsize=1)
def head_of(content: bytes) -> Head:
    return Head(content)


def lattice_scores(
    docs: DataFrame, model_file: str, modulus: int = 5, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row, ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are the words with A-Z lower-cased and one end. Rows whose ``crc32(doc_id) mod
    modulus`` equals ``held_out`` teach nothing. ``n_known`` of the tokens were learned,
    ``train_tokens`` is how many there are. ``base_score`` is a unigram with half a count added to every
    word, ``score`` the logarithm to base 10 of the text's probability over all segmentations. Null, empty and
    blank texts are one token, the end. Without any learned document all pieces are alike. Ids
    may be of any type; repeated rows count as often as they occur; empty tables give empty results.
    """
    spark = docs.sparkSession
    with open(model_file, "rb") as file:
        model = file.read()
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (remainder(id_col, modulus) == held_out).alias("held_out"), text_bytes(text_col).alias("bytes")
    )
    words = count_words(rows)
    totals = _totals(words)
    scores = word_scores(words, totals, *learn_pieces(words, model, totals), model)
    # The end of a text is always among them.
    head = scores.orderBy(F.col("word") != F.lit(END), F.desc("every"), "word").limit(HEAD).drop("every").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, head.schema) as writer:
        writer.write_table(head)
    shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    kind = docs.schema[id_col].dataType.simpleString()
    found = stored(
        rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
            functools.partial(_document_scores, shared),
            f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, "
            "score double, words array<binary>, counts array<long>",
        ),
        "lm-documents",
    )
    pairs = found.filter(F.size("words") > 0).select("row", F.explode(F.arrays_zip("words", "counts")).alias("w")).select(
        "row", F.col("w.words").alias("word"), F.col("w.counts").alias("n")
    )
    rest = (
        pairs.join(scores.select("word", "known", "base", "score"), "word")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("more_known"),
            F.sum(F.col("base") * F.col("n")).alias("more_base"),
            F.sum(F.col("score") * F.col("n")).alias("more_score"),
        )
    )
    zero = F.lit(0.0)
    return found.drop("words", "counts").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0).cast("long"))).alias("n_known"),
        F.lit(totals.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", zero)).alias("score"),
    )


def _totals(words: DataFrame) -> Totals:
    end = F.col("word") == F.lit(END)
    learned = (F.col("train") > 0).cast("long")
    row = words.agg(F.sum("train"), F.sum(learned), F.sum(F.when(end, F.col("train")).otherwise(0))).first()
    return Totals(*(value or 0 for value in row))


def _document_scores(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    head = head_of(shared.value)
    place_of, elsewhere = head.rows.get, itertools.repeat(-1)
    names = ["n_tokens", "n_known", "base_score", "score", "words", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    for batch in batches:
        out, rest, rest_times, sizes = [], [], [], [0]
        for text in batch.column("bytes"):
            words = text.as_py().lower().split()
            counts = Counter(words)
            counts[END] += 1
            places = np.fromiter(map(place_of, counts, elsewhere), np.int64, len(counts))
            times = np.fromiter(counts.values(), np.int64, len(counts))
            there = places >= 0
            rest += itertools.compress(counts, (~there).tolist())
            rest_times.append(times[~there])
            sizes.append(len(rest_times[-1]))
            places, times = places[there], times[there]
            out.append((len(words) + 1, int(times[head.known[places]].sum()), float(times @ head.base[places]), float(times @ head.score[places])))
        columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
        ends = pa.array(np.cumsum(sizes), pa.int32())
        columns += [
            pa.ListArray.from_arrays(ends, pa.array(rest, pa.binary())),
            pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *rest_times]), pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), *columns],
            names=["row", "doc_id", "held_out", *names],
        )
