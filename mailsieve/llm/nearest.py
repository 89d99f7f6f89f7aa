"""Nearest neighbours by a block matrix join with int8 tiles and exact recomputation.

Vectors are packed into chunks of ``rows`` rows where they lie: ids, floats, their int8 codes with a scale per row, and
the lengths of codes and of rounding errors. Query chunks meet candidate chunks in an equi-join: candidate chunks fall
into groups, query chunks are sent to every group by a shuffle, never through the driver. For a pair of chunks the int8 product gives every inner product up to
``|error of q| * |c| + |code of q| * |error of c|``. A pair of vectors survives if its upper bound reaches the best known
k-th lower bound of its query; survivors are computed in double precision from the original vectors, component by
component in order, and merged into a heap of k for each query. The heaps of all groups meet in a ranking window,
which cuts to k before its shuffle. The result is exact.

Defined results: vectors that are null, empty, zero or hold a null, NaN or infinite component take no part; vectors are
compared with those of their own length only; ties go to the smaller id; a query never meets a row with its own id;
rows with the same id count as candidates each, and each query row gives its own ranks; null ids take no part; other
columns are ignored; an empty table gives no rows. Products that leave the range of doubles give an infinite score, or none
that is a number, which ranks last.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.session import materialize

_CHUNK = "chunk bigint, dim int, ids binary, vectors binary"
_FOUND = "chunk bigint, place int, query_id bigint, vec_id bigint, score double"


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(vectors[id_column].cast("bigint").alias("id"), vectors[vector_column].alias("v"))
    return rows.filter("id is not null and size(v) > 0").filter(~F.exists("v", bad)).filter(F.exists("v", lambda x: x != 0))


def chunks(rows: DataFrame, size: int) -> DataFrame:
    """Rows packed into matrices of at most ``size`` rows, each of one length."""
    double = rows.schema["v"].dataType.elementType.simpleString() == "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_rows = TaskContext.get().partitionId() << 32, {}

        def pack(dim):
            nonlocal number
            ids, vs = zip(*open_rows.pop(dim))
            number += 1
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            values = [number, dim, np.array(ids, "<i8").tobytes(), np.array(vs, "<f8" if double else "<f4").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)], ["chunk", "dim", "ids", "vectors"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                open_rows.setdefault(len(v), []).append((i, v))
                if len(open_rows[len(v)]) == size:
                    yield pack(len(v))
        for dim in sorted(open_rows):
            yield pack(dim)

    return rows.mapInArrow(run, _CHUNK)


class Coded:
    """A chunk with its int8 codes and error lengths."""

    def __init__(self, ids: bytes, vectors: bytes, dim: int):
        self.ids = np.frombuffer(ids, "<i8")
        kind = "<f8" if len(vectors) == 8 * dim * len(self.ids) else "<f4"
        self.exact = np.frombuffer(vectors, kind).reshape(-1, dim).astype(np.float64)
        # All lengths are those of rows divided by their largest component, so that no square overflows or vanishes.
        self.scale = np.abs(self.exact).max(1)
        unit = self.exact / self.scale[:, None]
        self.codes = np.rint(unit * 127).astype(np.int8)
        decoded = self.codes / 127
        self.length = np.sqrt((decoded**2).sum(1))
        self.error = np.sqrt(((unit - decoded) ** 2).sum(1))
        self.full = np.sqrt((unit**2).sum(1))


def tile(q: Coded, c: Coded, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, candidate rows and exact products that may be among the k nearest; ``known``: k-th best so far."""
    # Products of int8 codes are whole numbers below 2**24 for up to 1040 components, so float32 holds them exactly.
    kind = np.float32 if q.codes.shape[1] <= 1040 else np.float64
    product = (q.codes.astype(kind) @ c.codes.astype(kind).T).astype(np.float64) / 127**2
    # The factor covers rounding in the bounds themselves.
    bound = 1.000001 * (q.error[:, None] * c.full + q.length[:, None] * c.error) + 1e-12 * q.full[:, None] * c.full
    other = q.ids[:, None] != c.ids
    with np.errstate(over="ignore", invalid="ignore"):
        sizes = q.scale[:, None] * c.scale
        lower, upper = (product - bound) * sizes, (product + bound) * sizes
        # Products beyond the range of doubles, or below it, prove nothing: such pairs are worked out.
        safe = (sizes < 1e290) & (sizes > 1e-290)
        lower = np.where(other & safe, lower, -np.inf)
        if lower.shape[1] >= k:
            known = np.maximum(known, np.partition(lower, -k, axis=1)[:, -k])
        rows, columns = np.nonzero(other & (~safe | (upper >= known[:, None])))
        score = np.zeros(len(rows))
        left, right = q.exact[rows], c.exact[columns]
        for d in range(left.shape[1]):  # in order, as a plain loop over the components adds them
            score += left[:, d] * right[:, d]
    return rows, columns, score


def _rank_of(score: float) -> float:
    """A score that is no number, from sums of infinite products, ranks last."""
    return score if score == score else -np.inf


def search(candidates: DataFrame, is_query: Column, id_column: str, vector_column: str, k: int = 20, rows: int = 1024, group_chunks: int = 8) -> DataFrame:
    """For each row of ``is_query`` (a condition on ``id``) its k nearest other rows by inner product."""
    good = usable(candidates, id_column, vector_column)
    all_chunks = materialize(chunks(good, rows), "chunks", large_rows=True)
    query_chunks = materialize(chunks(good.filter(is_query), rows), "queries", large_rows=True)
    groups = max(1, -(-all_chunks.count() // group_chunks))
    left = query_chunks.select(F.col("chunk").alias("q_chunk"), "dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = all_chunks.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int"))
    # Sizes are estimated without the copies that go to every group, so one side could be sent whole through the driver.
    pairs = left.hint("merge").join(right.drop("chunk"), ["dim", "part"]).select("q_chunk", "dim", "q_ids", "q_vectors", "ids", "vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Coded, list[list]]] = {}

        def emit(chunk):
            q, heaps = held.pop(chunk)
            out = [(chunk, i, int(q.ids[i]), -v, s) for i, heap in enumerate(heaps) for _, v, s in heap]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
            names = ["chunk", "place", "query_id", "vec_id", "score"]
            columns = [pa.array(x, t) for x, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for chunk, dim, q_ids, q_vectors, ids, vectors in zip(*(batch.column(i) for i in range(6))):
                chunk, dim = chunk.as_py(), dim.as_py()
                if chunk not in held:
                    if len(held) == 16:  # so many query chunks keep their heaps in a task
                        yield emit(next(iter(held)))
                    q = Coded(q_ids.as_py(), q_vectors.as_py(), dim)
                    held[chunk] = (q, [[] for _ in q.ids])
                q, heaps = held[chunk]
                c = Coded(ids.as_py(), vectors.as_py(), dim)
                known = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
                for row, column, score in zip(*(x.tolist() for x in tile(q, c, known, k))):
                    # The smallest of a heap is its worst: lowest score, then largest id.
                    entry, heap = (_rank_of(score), -int(c.ids[column]), score), heaps[row]
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry[:2] > heap[0][:2]:
                        heapq.heapreplace(heap, entry)
        for chunk in list(held):
            yield emit(chunk)

    best = Window.partitionBy("chunk", "place").orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), "vec_id")
    ranked = pairs.mapInArrow(run, _FOUND).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
