"""Byte-level BPE encoding and decoding on padded matrices.

Distinct unseen pieces become rows of integer matrices, one matrix for each length bucket. In every round each
row merges its leftmost pair of minimum rank, with the ranks of all pairs found in a hash table of numpy arrays;
rows without a mergeable pair leave the matrix, and columns that no row needs any more are cut off.

Defined results: a null or empty text has no ids, the digest of the empty string twice; rows with the same id,
or null ids, are encoded one by one and all returned; other columns are ignored. Pieces of more than
``LONG_PIECE`` bytes (runs of one character class without a break) merge by a heap in the same order, so their
time stays n log n. No row leaves its task, nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mailsieve.llm.tokens import PieceTable, arrow_rows

LONG_PIECE = 512
_NONE = np.int32(2**31 - 1)
_BUCKETS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, LONG_PIECE)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


class PairTable:
    """(left id, right id) -> id of the joined token, as an open-addressing table of two arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.bits = max(4, (4 * max(1, len(pairs))).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        left = np.fromiter(pairs, np.int64, len(pairs))
        value = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._slot(left)
        while left.size:
            free = self.keys[slot] == -1
            self.keys[slot[free]] = left[free]  # of several for one slot the last stays
            own = self.keys[slot] == left
            self.ranks[slot[own]] = value[own]
            left, value, slot = left[~own], value[~own], (slot[~own] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids (negative: padding); ``_NONE`` where they don't join."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(key.shape, _NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key, flat = key.ravel()[todo], out.ravel()
        slot = self._slot(key)
        while todo.size:
            there = self.keys[slot]
            hit = there == key
            flat[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there != -1)
            todo, key, slot = todo[on], key[on], (slot[on] + 1) & (len(self.keys) - 1)
        return flat.reshape(out.shape)


class MatrixBpe:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str):
        self.rank_of = read_ranks(path)
        self.pairs = PairTable(self.rank_of)
        self.byte_ids = np.array([self.rank_of[bytes([b])] for b in range(256)], np.int32)
        self.tokens = [b""] * (max(self.rank_of.values()) + 1)
        for token, rank in self.rank_of.items():
            self.tokens[rank] = token
        self.table = PieceTable(self.encode_pieces)
        self.decimals = [b"%d" % i for i in range(len(self.tokens))]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as a little-endian 32-bit buffer."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out: list[bytes] = [b""] * len(raw)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        low = 0
        for high in _BUCKETS:
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            # A matrix stays within a few MB, however many pieces there are.
            for at in range(0, len(rows), max(1, (1 << 19) // high)):
                self._matrix(raw, rows[at : at + max(1, (1 << 19) // high)], lengths, high, out)
            low = high
        for i in np.flatnonzero(lengths > LONG_PIECE):
            out[i] = self._heap(raw[i])
        return out

    def _matrix(self, raw, rows, lengths, width, out) -> None:
        data = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
        n = lengths[rows]
        ids = np.where(np.arange(width) < n[:, None], self.byte_ids[data], np.int32(-1))
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(1)  # the leftmost of equal minima
            best = ranks[np.arange(len(rows)), at]
            done = best == _NONE
            if done.any():
                flat, ends = ids[done], n[done]
                for i, row, end in zip(rows[done], flat, ends):
                    out[i] = row[:end].astype("<u4").tobytes()
                keep = ~done
                rows, n, at, best = rows[keep], n[keep], at[keep], best[keep]
                if not len(rows):
                    return
                ids, ranks = ids[keep], ranks[keep]
                if n.max() < ids.shape[1]:
                    ids, ranks = ids[:, : n.max()], ranks[:, : n.max() - 1]
            each = np.arange(len(rows))
            columns = np.arange(ids.shape[1] - 1)
            source = columns + (columns > at[:, None])
            merged = np.full(ids.shape, -1, np.int32)
            merged[:, :-1] = np.take_along_axis(ids, source, 1)
            merged[each, at] = best
            n = n - 1
            # The pair ranks move along; only the two around the new token are looked up.
            moved = np.full(ranks.shape, _NONE, np.int32)
            if ranks.shape[1] > 1:
                moved[:, :-1] = np.take_along_axis(ranks, source[:, :-1], 1)
            right = np.where(at + 1 < merged.shape[1], merged[each, np.minimum(at + 1, merged.shape[1] - 1)], -1)
            fresh = self.pairs.find(best, right)
            inside = at < ranks.shape[1]
            moved[each[inside], at[inside]] = fresh[inside]
            first = at > 0
            moved[each[first], at[first] - 1] = self.pairs.find(merged[each[first], at[first] - 1], best[first])
            ids, ranks = merged, moved

    def _heap(self, piece: bytes) -> bytes:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        size = len(ids)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        rank_of, tokens = self.rank_of, self.tokens
        join = lambda a, b: rank_of.get(tokens[ids[a]] + tokens[ids[b]])
        heap = [(r, i) for i in range(size - 1) if (r := join(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else size
            if j >= size or join(i, j) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if (r := join(i, k)) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := join(h, i)) is not None:
                heapq.heappush(heap, (r, h))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.table.buffers(texts)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_models: dict[str, MatrixBpe] = {}


def model(path: str) -> MatrixBpe:
    """One model for each worker process and rank file."""
    if path not in _models:
        _models[path] = MatrixBpe(path)
    return _models[path]


def encode_texts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row's id and its token ids as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for rows, texts in arrow_rows(batches):
            buffers = bpe.encode(texts)
            ends = np.cumsum([0, *(len(b) // 4 for b in buffers)])
            flat = np.frombuffer(b"".join(buffers), "<u4").astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column(0), ids], ["id", "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(docs[id_column], docs[text_column]).mapInArrow(run, f"id {kind}, ids array<int>").withColumnsRenamed({"id": id_column})


def decode_ids(encoded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Each row's id and the bytes of its token ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            data = [None if ids is None else bpe.decode(ids) for ids in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["id", "data"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(encoded[id_column], encoded[ids_column]).mapInArrow(run, f"id {kind}, data binary").withColumnsRenamed({"id": id_column})


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode and decode every text in one pass; per row the number of ids and digests of ids and decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for rows, texts in arrow_rows(batches):
            counts, ids_sha, data_sha = [], [], []
            for buffer in bpe.encode(texts):
                ids = np.frombuffer(buffer, "<u4").tolist()
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(b" ".join(map(bpe.decimals.__getitem__, ids))).hexdigest())
                data_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(data_sha, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(docs[id_column], docs[text_column]).mapInArrow(run, schema).withColumnsRenamed({"id": id_column})
