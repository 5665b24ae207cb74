"""SimHash near-duplicates by a hierarchical index in Gray order.

Upper nodes of the index are masked bit patterns. The first level masks all but one of
five bit segments: fingerprints that differ in at most four bits agree in one segment at
least, so pairs without a common upper node are pruned as whole groups. A node that many
fingerprints share is factored again, by five segments of the bits in which its members
differ, until they fit a bound. Nodes are dealt to tasks by their pattern.

Inside a node the fingerprints are sorted by their Gray rank, so that neighbours share
most bits, and each run of ``FANOUT`` is factored into the bits they share and the pattern
there; runs of such nodes are factored in turn. The search walks pairs of nodes downward.
The differences of two patterns within their common mask bound those of all members: a
pair of groups above the threshold is pruned, one that cannot exceed it is linked whole.

A task returns links that connect, not all pairs: each fingerprint and the smallest one
it reaches inside the node. Components of all links follow by star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import doc_column, lookup, stored, text_bytes
from colloquy.llm.components import components

SEED = 42
FANOUT = 16
#: Members of an upper node beyond which it is factored again.
NODE_LIMIT = 1 << 14
#: Pairs of nodes looked at together in a task, and rows gathered before a search.
PAIRS, ROWS = 1 << 20, 1 << 17


def fingerprint(text: bytes, width: int) -> int:
    """Bits set in more than half of the hashes of the word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(shingle, SEED) for shingle in shingles], "<u8")
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        block = hashes[start : start + (1 << 14)]
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, carry: bool) -> DataFrame:
    """``doc_id, fp`` (and ``doc``); ``fp`` is the unsigned value in a signed long."""

    @F.arrow_udf(T.LongType())
    def hashed(texts: pa.Array) -> pa.Array:
        values = np.array([fingerprint(text.as_py(), width) for text in texts], np.uint64)
        return pa.array(values.view(np.int64), pa.int64())

    return docs.select(F.col(id_col).alias("doc_id"), hashed(text_bytes(text_col)).alias("fp"), *doc_column(carry))


def _segments(mask: int, parts: int) -> list[int]:
    """The bits of a mask in ``parts`` masks of nearly equal size."""
    bits = [bit for bit in range(64) if mask >> bit & 1]
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << bit for bit in bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _upper_nodes(prints: DataFrame, distance: int, limit: int) -> DataFrame:
    """``mask, pattern, fp``: every fingerprint in its upper nodes, none above ``limit`` members.

    Members of a node differ in its open bits only, those in which not all agree. Codes
    within ``distance`` agree in one of ``distance + 1`` parts of them, so a large node becomes
    one for each part and pattern there. Every step settles open bits, and a node above the
    limit has more than ``distance`` of them, so the factoring ends.
    """
    if limit < 1 << (distance + 1):
        raise ValueError(f"a node must be allowed {1 << (distance + 1)} members")

    @F.udf("array<long>")
    def parts(mask: int, open_bits: int) -> list[int]:  # a row for each large node only
        mask, open_bits = mask % (1 << 64), open_bits % (1 << 64)
        return [_signed(mask | part) for part in _segments(open_bits, distance + 1)]

    def factored(df: DataFrame) -> DataFrame:
        split = df.select("fp", F.explode("parts").alias("mask"))
        return split.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"), "fp")

    first = [F.lit(_signed(part)) for part in _segments((1 << 64) - 1, distance + 1)]
    nodes = factored(prints.withColumn("parts", F.array(*first)))
    while True:
        open_bits = F.bit_or("fp").bitwiseAND(F.bitwise_not(F.bit_and("fp")))
        large = stored(
            nodes.groupBy("mask", "pattern")
            .agg(F.count("*").alias("n"), open_bits.alias("open_bits"))
            .filter(F.col("n") > limit)
            .select("mask", "pattern", parts("mask", "open_bits").alias("parts")),
            "simhash-large",
        )
        if large.isEmpty():
            return nodes
        flagged = nodes.join(lookup(large), ["mask", "pattern"], "left")
        small = flagged.filter("parts IS NULL").select("mask", "pattern", "fp")
        nodes = stored(small.unionByName(factored(flagged.filter("parts IS NOT NULL"))), "simhash-nodes")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The position of a code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class _Union:
    """Sets of row numbers, merged by whole arrays of pairs."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def find(self, rows: np.ndarray) -> np.ndarray:
        roots = self.parent[rows]
        while not np.array_equal(above := self.parent[roots], roots):
            roots = above
        self.parent[rows] = roots
        return roots

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def _grouped(starts: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Starts of runs of at most ``FANOUT`` equal entries of ``groups``."""
    position = np.arange(len(groups)) - starts[np.searchsorted(starts, np.arange(len(groups)), "right") - 1]
    return np.flatnonzero(position % FANOUT == 0)


def connect(groups: np.ndarray, codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (code, smaller code) that connect what lies within ``distance`` inside each group."""
    order = np.lexsort((gray_rank(codes), groups))
    groups, codes = groups[order], codes[order]
    # levels[0] are the codes; each further level factors runs of the one below.
    ones, zeros, owner = [codes], [~codes], [groups]
    first, spans = [np.arange(len(codes))], []
    while True:
        begin = np.flatnonzero(np.r_[True, owner[-1][1:] != owner[-1][:-1]])
        if spans and len(begin) == len(owner[-1]):
            break
        runs = _grouped(begin, owner[-1])
        spans.append(np.r_[runs, len(owner[-1])])
        ones.append(np.bitwise_and.reduceat(ones[-1], runs))
        zeros.append(np.bitwise_and.reduceat(zeros[-1], runs))
        first.append(first[-1][runs])
        owner.append(owner[-1][runs])
    union = _Union(len(codes))
    top = len(spans)
    roots = np.arange(len(owner[top]))
    last = [np.r_[f[1:], len(codes)] for f in first]
    work = [(top, roots, roots)]
    while work:
        level, a, b = work.pop()
        known = (ones[level][a] | zeros[level][a]) & (ones[level][b] | zeros[level][b])
        differ = np.bitwise_count((ones[level][a] ^ ones[level][b]) & known)
        open_bits = np.bitwise_count(~known)
        near = differ <= distance
        whole = near & (differ + open_bits <= distance)
        for nodes in (a[whole], b[whole]) if level else ():
            size = last[level][nodes] - first[level][nodes]
            head = np.repeat(first[level][nodes], size)
            union.merge(head, head + _counting(size))
        union.merge(first[level][a[whole]], first[level][b[whole]])
        a, b = a[near & ~whole], b[near & ~whole]
        if not len(a):
            continue
        span = spans[level - 1]
        wide, high = span[a + 1] - span[a], span[b + 1] - span[b]
        pairs = wide * high
        for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(pairs) // PAIRS)) + 1):
            n, h = pairs[part], high[part]
            place, h = _counting(n), np.repeat(h, n)
            i = np.repeat(span[a[part]], n) + place // h
            j = np.repeat(span[b[part]], n) + place % h
            forward = i <= j
            work.append((level - 1, i[forward], j[forward]))
    roots = union.find(np.arange(len(codes)))
    moved = roots != np.arange(len(codes))
    return codes[moved], codes[roots[moved]]


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. for each size in turn."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def near_links(prints: DataFrame, distance: int, limit: int = NODE_LIMIT) -> DataFrame:
    """``a, b``: links between distinct fingerprints (``fp``) that connect all within ``distance`` bits."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def found(done: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            keys, codes = (np.concatenate(column) for column in zip(*done, strict=True))
            a, b = connect(keys, codes.view(np.uint64), distance)
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            key, code = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # Rows come sorted by key: all but the last key of a batch are complete.
            cut = int(np.searchsorted(key, key[-1]))
            held.append((key[:cut], code[:cut]))
            if sum(len(k) for k, _ in held) >= ROWS and cut:
                yield found(held)
                held = []
            held.append((key[cut:], code[cut:]))
        if held:
            yield found(held)

    nodes = _upper_nodes(prints.select("fp"), distance, limit)
    # Two nodes with one key cost time only: every link is decided on whole fingerprints.
    keyed = nodes.select(F.xxhash64("mask", "pattern").alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(search, "a long, b long")


def _classes(rows: DataFrame, distance: int) -> DataFrame:
    """Stored ``fp, least`` from ``doc_id, fp, row``: the row of the smallest id that a fingerprint reaches."""
    prints = stored(
        rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")),
        "simhash-prints",
    )
    links = stored(near_links(prints, distance), "simhash-links")
    linked = stored(
        components(links).join(prints, F.col("node") == F.col("fp")).select("fp", "root", "best"), "simhash-linked"
    )
    roots = stored(linked.groupBy("root").agg(F.min("best").alias("least")), "simhash-roots")
    moved = stored(linked.join(lookup(roots), "root").select("fp", "least"), "simhash-moved")
    return stored(
        prints.join(lookup(moved), "fp", "left").select("fp", F.coalesce("least", "best").alias("least")),
        "simhash-classes",
    )


def _numbered(docs: DataFrame, id_col: str, text_col: str, width: int, carry: bool) -> DataFrame:
    rows = fingerprints(docs, id_col, text_col, width, carry).withColumn("row", F.monotonically_increasing_id())
    return stored(rows, "simhash-rows")


def simhash_components(
    docs: DataFrame, width: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    A-Z are lower-cased; shingles are ``width`` words, or all of them if there are fewer.
    Null, empty and blank texts have fingerprint zero and are linked like any other.
    Fingerprints link at ``distance`` or fewer differing bits; ``component_id`` is the
    smallest id reachable, null ids counting only where there is no other. Copies are one
    fingerprint from the start; links are kept between distinct fingerprints only.
    """
    rows = _numbered(docs, id_col, text_col, width, carry=False)
    return rows.join(lookup(_classes(rows, distance)), "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("least.doc_id").alias("component_id"),
    )


def one_per_component(
    docs: DataFrame, width: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The input rows without near-duplicates, whole: of each component one row with the smallest id.

    Only numbers of rows that go meet the rows again; no document is shuffled for that
    unless those numbers are too many to broadcast.
    """
    rows = _numbered(docs, id_col, text_col, width, carry=True)
    narrow = rows.select("doc_id", "fp", "row")
    classes = lookup(_classes(narrow, distance))
    gone = stored(narrow.join(classes, "fp").filter("row <> least.row").select("row"), "simhash-gone")
    return rows.join(lookup(gone), "row", "left_anti").select("doc.*")
