"""Exact top-k inner products over a bit-sliced index.

The index holds blocks of rows. Each attribute of a block is its quantised value plus an
offset, cut into bit slices: slice ``s`` is a bitmap of the rows that have bit ``s``. For
one query, every slice of every attribute enters as many sums as its factor has bits;
bitmaps of equal weight are added three to two by full adders until each weight has one,
which are the slices of all scores. The best rows are then selected from the most
significant slice downward, and those at the boundary by their exact order.

Queries are a stated set of rows. They pass over the index in chunks of a bounded number,
each broadcast; a block returns its best few for each, and the best of those are kept.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import stored

#: Rows of an index block, queries broadcast at once, and the largest size of a quantised component.
BLOCK_ROWS, CHUNK_QUERIES, LARGEST = 1 << 14, 1 << 11, 1 << 62

INDEX = "ids binary, n int, dims int, low array<long>, slices binary, bits int"


def quantised(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component as longs; null if any is null or not finite, an error if one is too large."""
    scaled = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    usable = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
    )
    fits = F.forall(vector, lambda x: F.abs(x.cast("double")) <= LARGEST / scale)
    large = F.raise_error(F.lit(f"a component beyond {LARGEST / scale:g} can't be indexed")).cast("array<long>")
    return F.when(usable & fits, scaled).when(usable, large)


def build_slices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``low`` of each attribute and its bitmaps ``[bit, attribute, word]`` of ``value - low``."""
    rows, dims = values.shape
    low = values.min(axis=0)
    above = (values - low).astype(np.uint64)
    bits = max(1, int(above.max(initial=0)).bit_length())
    words = -(-rows // 64)
    slices = np.zeros((bits, dims, words * 8), np.uint8)
    for bit in range(bits):
        plane = ((above >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
        slices[bit, :, : -(-rows // 8)] = np.packbits(plane, axis=0, bitorder="little").T
    return low, slices.view("<u8")


def add_slices(columns: dict[int, list[np.ndarray]], top: int) -> list[np.ndarray | None]:
    """Slices of the sum, modulo ``2 ** top``; ``columns`` holds stacks of bitmaps by weight."""
    out: list[np.ndarray | None] = []
    for weight in range(top):
        stack = columns.pop(weight, [])
        maps = np.concatenate(stack) if stack else None
        while maps is not None and len(maps) > 1:
            third = max(1, len(maps) // 3)
            a, b = maps[:third], maps[third : 2 * third]
            either = a ^ b
            if len(maps) == 2:
                carry, maps = a & b, either
            else:
                c = maps[2 * third : 3 * third]
                carry = (a & b) | (either & c)
                maps = np.concatenate([either ^ c, maps[3 * third :]])
            columns.setdefault(weight + 1, []).append(carry)
        out.append(None if maps is None else maps[0])
    return out


def score_slices(slices: np.ndarray, low: np.ndarray, query: np.ndarray) -> tuple[list[np.ndarray | None], int]:
    """Slices of ``score - base`` for all rows of a block, and ``base``.

    A negative factor ``-f`` counts ``f`` times the complement of each slice, which is the
    attribute's largest value less the value; the base takes that off again.
    """
    bits = len(slices)
    size, negative = np.abs(query), query < 0
    full = (1 << bits) - 1
    base = sum(int(q) * int(v) for q, v in zip(query, low, strict=True)) - full * sum(size[negative].tolist())
    top = (full * sum(size.tolist())).bit_length()
    columns: dict[int, list[np.ndarray]] = {}
    for factor_bit in range(int(size.max(initial=0)).bit_length()):
        has = (size >> factor_bit) & 1 == 1
        plain, turned = np.flatnonzero(has & ~negative), np.flatnonzero(has & negative)
        for bit in range(bits):
            stack = columns.setdefault(factor_bit + bit, [])
            if len(plain):
                stack.append(slices[bit, plain])
            if len(turned):
                stack.append(~slices[bit, turned])
    return add_slices(columns, top), base


def select_top(sums: list[np.ndarray | None], valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows surely among the best ``k``, and of those tied for the places left."""
    sure, tied = np.zeros_like(valid), valid
    left = k
    for bitmap in reversed(sums):
        if bitmap is None:
            continue
        have = tied & bitmap
        count = int(np.bitwise_count(have).sum())
        if count > left:
            tied = have
        else:
            sure, left = sure | have, left - count
            tied = tied & ~bitmap
        if not left:
            return sure, np.zeros_like(valid)
    return sure, tied


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def block_top(ids, low, slices, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The best ``k`` (id, score) of a block whose rows are sorted by id, without the query's id."""
    dims, rows = len(low), len(ids)
    common = min(dims, len(query))
    factors = np.zeros(dims, np.int64)
    factors[:common] = query[:common]
    valid = np.packbits(np.ones(rows, np.uint8), bitorder="little")
    valid = np.concatenate([valid, np.zeros(slices.shape[2] * 8 - len(valid), np.uint8)]).view("<u8")
    begin, end = np.searchsorted(ids, query_id), np.searchsorted(ids, query_id, "right")
    for row in range(begin, end):
        valid[row // 64] &= ~np.uint64(1 << (row % 64))
    sums, base = score_slices(slices, low, factors)
    sure, tied = select_top(sums, valid, k)
    rows_sure = _rows(sure)
    chosen = np.concatenate([rows_sure, _rows(tied)[: k - len(rows_sure)]])
    scores = [base] * len(chosen)
    for bit, bitmap in enumerate(sums):
        if bitmap is not None:
            word, place = chosen // 64, (chosen % 64).astype(np.uint64)
            scores = [s + (int(b) << bit) for s, b in zip(scores, bitmap[word] >> place & np.uint64(1), strict=True)]
    return [(int(ids[row]), score) for row, score in zip(chosen, scores, strict=True)]


def bit_sliced_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Index blocks of ``id, q`` (arrays of longs); vectors shorter than the longest of a block count zeros."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque[tuple[np.ndarray, list]] = deque()

        def block() -> pa.RecordBatch:
            ids = np.concatenate([pair[0] for pair in held])
            vectors = [v for pair in held for v in pair[1]]
            held.clear()
            dims = max(map(len, vectors))
            values = np.zeros((len(ids), dims), np.int64)
            for row, vector in enumerate(vectors):
                values[row, : len(vector)] = vector
            order = np.argsort(ids, kind="stable")
            low, slices = build_slices(values[order])
            columns = [
                pa.array([ids[order].astype("<i8").tobytes()], pa.binary()),
                pa.array([len(ids)], pa.int32()),
                pa.array([dims], pa.int32()),
                pa.array([low.tolist()], pa.list_(pa.int64())),
                pa.array([slices.tobytes()], pa.binary()),
                pa.array([len(slices)], pa.int32()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "n", "dims", "low", "slices", "bits"])

        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                part = batch.slice(start, block_rows)
                held.append((part.column(0).to_numpy(), [v.values.to_numpy() for v in part.column(1)]))
                if sum(len(pair[0]) for pair in held) >= block_rows:
                    yield block()
        if held:
            yield block()

    return vectors.mapInArrow(built, INDEX)


def top_k(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    chunk_queries: int = CHUNK_QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of highest inner product for each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows of another
    id. Components become ``floor(scale * x)``. Equal scores go to the smaller id. Rows with
    a null id take no part, nor do vectors that are null or hold a null or a non-finite
    component. A component beyond ``LARGEST`` after scaling, or a score among the best that
    does not fit a long, is an error. Vectors of unequal length count zeros. Empty vectors
    score 0. A repeated row counts as often as it
    occurs; a query row that occurs twice is asked once. Fewer than ``k`` candidates are all
    returned.
    """
    spark = vectors.sparkSession
    usable = stored(
        vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("q"))
        .filter("id IS NOT NULL AND q IS NOT NULL"),
        "topk-vectors",
    )
    index = stored(bit_sliced_index(usable, block_rows), "topk-index")
    queries = usable.filter(F.col("id") % every == 0).distinct()
    chunks = max(1, math.ceil(queries.count() / chunk_queries))
    queries = stored(queries.withColumn("chunk", F.pmod(F.xxhash64("id", "q"), F.lit(chunks))), "topk-queries")
    best = None
    for chunk in range(chunks):
        asked = queries.filter(F.col("chunk") == chunk).select("id", "q").collect()  # about chunk_queries rows
        shared = spark.sparkContext.broadcast([(row["id"], np.array(row["q"], np.int64)) for row in asked])

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in batch.to_pylist():
                    ids = np.frombuffer(block["ids"], "<i8")
                    shape = block["bits"], block["dims"], -(-block["n"] // 64)
                    slices = np.frombuffer(block["slices"], "<u8").reshape(shape)
                    low = np.array(block["low"], np.int64)
                    out = [
                        (query_id, number, *pair)
                        for number, (query_id, query) in enumerate(shared.value)
                        for pair in block_top(ids, low, slices, query_id, query, k)
                    ]
                    columns = list(zip(*out, strict=True)) or [[]] * 4
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(column, pa.int64()) for column in columns],
                        names=["query_id", "number", "vec_id", "score"],
                    )

        part = index.mapInArrow(searched, "query_id long, number long, vec_id long, score long")
        part = stored(part.withColumn("chunk", F.lit(chunk)), "topk-found")
        best = part if best is None else best.unionByName(part)
    order = Window.partitionBy("chunk", "number").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
