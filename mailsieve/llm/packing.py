"""Lexical retrieval packing: windows of related pieces by a sharded BM25 index.

1. Every text is encoded whole and cut at multiples of the window: full pieces are windows of their own, the tail
   goes on to packing. The checksums of all pieces follow from the ids at hand. In the same pass each task counts, for
   every token id, the pieces (full ones and tails) that hold it; its counts are a row beside its pieces.
2. The counts are added up; a vocabulary-sized table reaches the driver. Number, mean length and frequencies are those
   of all pieces of all texts.
3. Tails are dealt to shards of at most ``shard_rows`` rows. Tails whose heaviest token (term frequency times inverse
   document frequency) is the same stand together; a token with more tails than a shard holds spreads over several
   shards by the hash of the row. Shard borders come from the counts of heaviest tokens, again vocabulary-sized.
4. In a shard an inverted index of BM25 weights is built. The first unused tail seeds a window; all its terms are looked
   up, and the unused neighbours fill the window in order of their score: first those that fit whole, then the best one
   that is left is cut, its rest staying unused for a later window.

Only the last window of a shard, and gaps under ``min_piece`` ids, are padded. Defined results: a null or empty text is
the end id alone; rows with equal or null ids are packed one by one; ties of score go to the earlier row of the shard
(by row hash, then id); an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.tokens import arrow_rows, library_encoder
from mailsieve.session import scratch_path

_PIECES = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
#: Pieces; a row of counts has no id or row, ``start`` -1 and pairs of token id and count in ``tail``.
_CUT = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, row bigint, tail binary"


def cut_texts(docs: DataFrame, path: str, window: int, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """Full pieces (``tail`` null, a window id of their own), tails (``tail``: ids) and a row of counts for each task."""
    kinds = [pa.int64()] * 7 + [pa.binary()]
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "row", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        count = TaskContext.get().partitionId() << 40
        kind = "<i4" if encoder.vocabulary > 1 << 16 else "<u2"
        held = np.zeros(max(encoder.vocabulary, end_id + 1), np.int64)
        for part, texts in arrow_rows(batches):
            rows = []
            for i, buffer in zip(part.column(0).to_pylist(), encoder.buffers(texts)):
                buffer += end
                n = len(buffer) // 4
                for start in range(0, n, window):
                    piece, count = buffer[4 * start : 4 * (start + window)], count + 1
                    size, ids = len(piece) // 4, np.frombuffer(piece, "<u4").astype(kind)
                    held[np.unique(ids)] += 1
                    tail = None if size == window else ids.tobytes()
                    rows.append((i, start, size, zlib.crc32(piece), n, 2 * count + 1, count, tail))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
        there = np.flatnonzero(held)
        if len(there):
            counts = np.stack([there, held[there]], axis=1).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((None, -1, 0, 0, 0, None, None, counts), kinds)], names)

    return docs.select(docs[id_column].cast("bigint"), docs[text_column]).mapInArrow(run, _CUT)


def _ids(tail: bytes, width: int) -> np.ndarray:
    return np.frombuffer(tail, f"<u{width}").astype(np.int64)


def piece_frequencies(counts: DataFrame, vocabulary: int) -> np.ndarray:
    """Number of pieces that hold each token id, from the rows of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for pairs in batch.column(0):
                token, n = np.frombuffer(pairs.as_py(), "<i8").reshape(-1, 2).T
                total[token] += n
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["token", "n"])

    counted = counts.select("tail").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    out = np.zeros(vocabulary, np.int64)
    for token, n in counted.collect():  # at most one row for each id of the vocabulary
        out[token] = n
    return out


def heaviest_token(tails: DataFrame, idf: np.ndarray, width: int) -> DataFrame:
    """Each tail with the token of the largest term frequency times inverse document frequency (ties: smaller id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heavy = []
            for tail in batch.column(batch.schema.get_field_index("tail")):
                token, count = np.unique(_ids(tail.as_py(), width), return_counts=True)
                heavy.append(token[(count * idf[token]).argmax()])
            yield batch.append_column("heavy", pa.array(heavy, pa.int64()))

    return tails.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tails.schema) + ", heavy bigint")


def shard_borders(counts: dict[int, int], shard_rows: int) -> dict[int, tuple[int, int]]:
    """For each heaviest token the first of its shards and how many it has; no shard is meant to get over ``shard_rows``."""
    out, shard, filled = {}, 0, 0
    for token, n in sorted(counts.items()):
        if n > shard_rows // 2:
            shard, filled = shard + (filled > 0), 0
            parts = math.ceil(2 * n / shard_rows)  # half full on average, as rows fall to them by hash
            out[token] = (shard, parts)
            shard += parts
        else:
            if filled + n > shard_rows:
                shard, filled = shard + 1, 0
            out[token] = (shard, 1)
            filled += n
    return out


class Shard:
    """BM25 inverted index over the tails of one shard, with the rows that are still unused."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float, k1: float = 1.2, b: float = 0.75):
        self.n = len(ids)
        lengths = np.array([len(x) for x in ids], np.float64)
        row = np.repeat(np.arange(self.n), lengths.astype(np.int64))
        key, count = np.unique(np.concatenate(ids) * self.n + row, return_counts=True)  # by token, then row
        token, self.rows = key // self.n, key % self.n
        self.weights = idf[token] * count * (k1 + 1) / (count + k1 * (1 - b + b * lengths[self.rows] / mean_length))
        terms, first = np.unique(token, return_index=True)
        self.first = np.append(first, len(key))
        term = np.repeat(np.arange(len(terms)), np.diff(self.first))
        order = np.argsort(self.rows, kind="stable")  # each row's terms
        self.terms, self.ends = term[order], np.searchsorted(self.rows[order], np.arange(self.n + 1))
        self.alive = np.ones(self.n, bool)

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused rows by falling score for the seed's terms; rows without a common term come last."""
        terms = self.terms[self.ends[seed] : self.ends[seed + 1]]
        spans = [slice(self.first[t], self.first[t + 1]) for t in terms]
        scores = np.bincount(
            np.concatenate([self.rows[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), self.n
        )
        rows = np.flatnonzero(self.alive)
        return rows[np.argsort(-scores[rows], kind="stable")]


def pack_shard(ids: list[np.ndarray], shard: Shard, window: int, min_piece: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces of the shard's windows: row, first id, ids, window, offset there."""
    done = np.zeros(len(ids), np.int64)  # ids of each row that are packed
    sizes = np.array([len(x) for x in ids], np.int64)
    number = 0
    for seed in range(len(ids)):
        while shard.alive[seed]:
            left, row, number, offset = window, seed, number + 1, 0
            order = left_sizes = None
            while row is not None:
                take = min(left, sizes[row] - done[row])
                yield row, done[row], take, number, offset
                done[row] += take
                offset, left = offset + take, left - take
                if done[row] == sizes[row]:
                    shard.alive[row] = False
                row = None
                if left:
                    if order is None:
                        order = shard.neighbours(seed)
                        left_sizes = sizes[order] - done[order]
                    fits = (left_sizes <= left) & shard.alive[order]
                    at = fits.argmax() if len(order) else 0
                    if len(order) and fits[at]:
                        row = order[at]
                    elif left >= min_piece and len(unused := order[shard.alive[order]]):
                        row = unused[0]


def pack(
    docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text",
    shard_rows: int = 2048, min_piece: int = 8,
) -> DataFrame:
    """One row for each piece: its place in its text, checksum, window and place there."""
    spark, place = docs.sparkSession, scratch_path(docs.sparkSession, "pieces")
    cut_texts(docs, path, window, end_id, id_column, text_column).write.parquet(place)
    cut = spark.read.schema(_CUT).parquet(place)
    counts, pieces = cut.filter("start = -1"), cut.filter("start >= 0")
    full, tails = pieces.filter("tail is null"), pieces.filter("tail is not null")
    vocabulary = max(library_encoder(path).vocabulary, end_id + 1)
    width = 4 if library_encoder(path).vocabulary > 1 << 16 else 2
    n, tokens = pieces.agg(F.count("*"), F.sum("length")).first()
    mean_length = (tokens or 0) / max(1, n)
    frequency = piece_frequencies(counts, vocabulary)
    idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))

    keyed_place = scratch_path(spark, "tails")
    keyed = heaviest_token(tails.drop("ids_crc32", "sequence_id"), idf, width)
    keyed.write.parquet(keyed_place)
    keyed = spark.read.schema(keyed.schema).parquet(keyed_place)
    heavy = dict(keyed.groupBy("heavy").count().collect())  # at most one row for each id of the vocabulary
    borders = shard_borders(heavy, shard_rows)
    table = spark.createDataFrame([(t, s, p) for t, (s, p) in borders.items()], "heavy bigint, shard bigint, parts bigint")
    spot = F.xxhash64("id", "start", "row")
    dealt = (
        keyed.join(F.broadcast(table), "heavy")  # as large as the vocabulary at most
        .select((F.col("shard") + F.pmod(spot, F.col("parts"))).alias("shard"), "id", "start", "doc_tokens", "row", "tail", spot.alias("spot"))
    )

    def run(part: pa.Table) -> pa.Table:  # one shard
        part = part.sort_by([("spot", "ascending"), ("id", "ascending"), ("row", "ascending")])
        ids = [_ids(x.as_py(), width) for x in part.column("tail")]
        owner, start, total = (part.column(c).to_pylist() for c in ("id", "start", "doc_tokens"))
        shard = part.column("shard")[0].as_py()
        rows = [
            (owner[r], start[r] + first, size, zlib.crc32(ids[r][first : first + size].astype("<u4").tobytes()), total[r], 2 * (shard << 32 | number), offset)
            for r, first, size, number, offset in pack_shard(ids, Shard(ids, idf, mean_length), window, min_piece)
        ]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], _NAMES)

    packed = dealt.groupBy("shard").applyInArrow(run, _PIECES)
    whole = full.select("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("bigint").alias("offset"))
    return packed.unionByName(whole).withColumnRenamed("id", id_column)
