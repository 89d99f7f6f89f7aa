"""Token counts by heap-and-linked-list byte-pair merging; no ids are given out.

The symbols of a piece, one for each byte, form a doubly linked list; a heap holds its joinable pairs by rank and place.
The lowest is popped and merged until none is left: a piece has as many tokens as symbols less merges. Texts are cut
at the strings of the vocabulary's added tokens, which count one each, then into the pieces of the published pattern.
A task counts each piece once and looks it up afterwards in a bounded table that compares whole pieces.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows with the same or a null id are counted one by one
and all returned; other columns are ignored; an empty table gives no rows. A piece of any length takes n log n steps. No
row leaves its task, nothing is shuffled. A vocabulary of another kind (normalizer, other pieces, unknown bytes) is an error.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from mailsieve.llm.tokens import PieceTable, arrow_rows, is_settled


def byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary file writes for each byte: itself if printable, else 256 and on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairCounter:
    """Counts for one byte-level vocabulary file of the tokenizers library."""

    #: Pieces of texts outside the settled blocks that are remembered.
    MAX_SEEN = 200_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pieces = spec["model"], spec["pre_tokenizer"] or {}
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        odd_token = any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
        if (
            spec["normalizer"] or model["type"] != "BPE" or any(pieces.get(k) != v for k, v in usual.items()) or odd_token
            or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        ):
            raise ValueError(f"{path} is no plain byte-level pair vocabulary")
        ids = model["vocab"]
        letters = byte_letters()
        self.symbol = [ids[x] for x in letters]
        self.byte_of = {x: b for b, x in enumerate(letters)}
        self.joins: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.joins[ids[left] << 32 | ids[right]] = (rank, ids[left + right])
        whole = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, whole))) if whole else None
        self.path, self.library, self.seen = path, None, {}
        self.table = PieceTable(lambda found: [self.count(p.encode()).to_bytes(4, "little") for p in found])

    def count(self, piece: bytes) -> int:
        """Tokens of one piece."""
        symbols, joins = [self.symbol[b] for b in piece], self.joins
        size = left = len(symbols)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = []
        for i in range(size - 1):
            if found := joins.get(symbols[i] << 32 | symbols[i + 1]):
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j == size:
                continue
            now = joins.get(symbols[i] << 32 | symbols[j])
            if now is None or now[1] != joined:  # one of the two has been merged since
                continue
            symbols[i], symbols[j], left = joined, -1, left - 1
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if found := joins.get(joined << 32 | symbols[k]):
                    heapq.heappush(heap, (found[0], i, found[1]))
            if (h := before[i]) >= 0 and (found := joins.get(symbols[h] << 32 | joined)):
                heapq.heappush(heap, (found[0], h, found[1]))
        return left

    def _unsettled(self, text: str) -> int:
        """Characters whose class depends on the version of the character database are cut as the library cuts them."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        total = 0
        for piece, _ in self.library.pre_tokenize_str(text):
            n = self.seen.get(piece)
            if n is None:
                if len(self.seen) >= self.MAX_SEEN:
                    self.seen.clear()
                n = self.seen[piece] = self.count(bytes(map(self.byte_of.__getitem__, piece)))
            total += n
        return total

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        total, parts, owner = np.zeros(len(texts), np.int64), [], []
        for i, text in enumerate(texts):
            if self.added and self.added.search(text):
                total[i] += sum(1 for _ in self.added.finditer(text))
                runs = self.added.split(text)
            else:
                runs = [text]
            for run in runs:
                if is_settled(run):
                    parts.append(run)
                    owner.append(i)
                else:
                    total[i] += self._unsettled(run)
        sums = [int(np.frombuffer(b, "<u4").sum(dtype=np.int64)) for b in self.table.buffers(parts)]
        np.add.at(total, owner, sums) if owner else None
        return total


_counters: dict[str, PairCounter] = {}


def counter(path: str) -> PairCounter:
    """One counter for each worker process and vocabulary."""
    if path not in _counters:
        _counters[path] = PairCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row: UTF-8 bytes, tokens, and whether these are more than ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for rows, texts in arrow_rows(batches):
            n = tokens.counts(texts)
            size = pc.fill_null(pc.binary_length(rows.column(1)), 0).cast(pa.int64())
            columns = [rows.column(0), size, pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_column].dataType.simpleString()
    counted = docs.select(docs[id_column], docs[text_column]).mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return counted.withColumnsRenamed({"id": id_column})
