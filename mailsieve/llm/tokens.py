"""Pieces of texts and a bounded table of their token ids, shared by the operators that tokenize.

Byte-level vocabularies encode every match of one pattern by itself, so the ids of a text are the ids of its
pieces in order. A corpus repeats its pieces: each task encodes a piece once and looks it up afterwards.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Characters of long-settled Unicode blocks, whose classes are the same in every version of the character database;
#: for these array operations split exactly as the published pattern does.
_SETTLED = [*range(0x250), *range(0x2010, 0x2028), 0x20AC]
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
_UNSETTLED = re.compile("[^\x00-ɏ‐-‧€]")


_full = None


def is_settled(text: str) -> bool:
    """Whether every character lies in the blocks that the fast splitter knows."""
    return text.isascii() or _UNSETTLED.search(text) is None


def split_pieces(text: str) -> list[str]:
    """All matches of the published pattern, in order; they cover the text."""
    global _full
    if _full is None:
        import public_tokenizers
        import regex

        _full = regex.compile(public_tokenizers.PATTERN)
    return _full.findall(text)


#: Characters that are worked on at once.
SLICE = 1 << 19
_LETTER, _NUMBER, _OTHER, _WHITE, _BORDER = 1, 2, 3, 4, 5
_SEPARATOR = "\uffff"  # not settled, so no text that is cut here holds it
_CUT = re.compile(" (?=[A-Za-z])")
_FACTOR = 0x9E3779B97F4A7C15 | 1


class _Classes:
    """Class and random 64-bit value of each character up to the separator."""

    def __init__(self):
        self.kind = np.full(0x10000, _OTHER, np.uint8)
        for c in _SETTLED:
            category = unicodedata.category(chr(c))[0]
            self.kind[c] = {"L": _LETTER, "N": _NUMBER}.get(category, _OTHER)
        self.kind[[ord(c) for c in _SPACE]] = _WHITE
        self.kind[0xFFFF] = _BORDER
        self.value = np.random.default_rng(5).integers(1, 1 << 63, 0x10000, np.uint64)
        self.powers, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            back = pow(_FACTOR, -1, 1 << 64)
            self.powers = np.cumprod(np.append(np.uint64(1), np.full(n - 1, _FACTOR, np.uint64)))
            self.inverse = np.cumprod(np.append(np.uint64(1), np.full(n - 1, back, np.uint64)))


def piece_starts(chars: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a piece of the published pattern starts at each character; borders are pieces of their own.

    Runs of one class are pieces. Of white space before a text character the last stands alone, or, if it is a blank,
    begins the next piece. An apostrophe with s, t, m, d, re, ve or ll is a piece where no run of signs holds it.
    """
    n = len(chars)
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _BORDER)
    white = kind == _WHITE
    last = np.flatnonzero(white[:-1] & ~white[1:] & (kind[1:] != _BORDER))
    start[last] = True
    start[last + 1] = chars[last] != 32
    mark = np.flatnonzero(chars[:-1] == 39)
    if len(mark):
        before = np.where(mark > 0, kind[mark - 1], _BORDER)
        mark = mark[(before != _OTHER) & ((before != _WHITE) | (chars[mark - 1] != 32))]
        one, two = chars[mark + 1], chars[np.minimum(mark + 2, n - 1)]
        two = np.where(mark + 2 < n, two, 0)
        short = np.isin(one, [115, 116, 109, 100])
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        start[mark[short | long] + 1] = False
        ends = np.concatenate([mark[short] + 2, mark[long] + 3])
        start[ends[ends < n]] = True
    return start


_classes: _Classes | None = None


class PieceTable:
    """Token ids of texts by way of a bounded hash table of pieces, in numpy arrays.

    Pieces are found and hashed (64 bits, from random values of their characters) for many texts at once; only pieces
    that the table does not hold become strings. The hash only leads to a slot: the characters of every piece are
    compared with those stored there, and a piece that shares another one's hash is encoded by itself. ``encode`` gets a
    list of distinct pieces and returns their ids as little-endian unsigned 32-bit buffers. At ``max_entries`` pieces or
    ``MAX_LETTERS`` stored characters the table starts anew, so memory does not grow with the corpus. Texts with
    characters outside the settled blocks are split by the full pattern and encoded piece by piece.
    """

    MAX_LETTERS = 1 << 24

    def __init__(self, encode: Callable[[list[str]], list[bytes]], max_entries: int = 800_000):
        global _classes
        if _classes is None:
            _classes = _Classes()
        self.encode, self.max_entries = encode, max(max_entries, 3 * SLICE // 2)  # what one slice can hold fits
        self.bits = (2 * self.max_entries).bit_length()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.first = np.zeros(1 << self.bits, np.int32)
        self.size = np.zeros(1 << self.bits, np.int32)
        self.pool, self.used, self.entries = np.zeros(1 << 16, np.uint32), 0, 0
        self.spelled = np.zeros(1 << self.bits, np.int64)  # where the characters of a piece begin, and their number
        self.letters_of = np.zeros(1 << self.bits, np.int32)
        self.letters, self.lettered = np.zeros(1 << 16, np.uint16), 0

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or the free one where it belongs."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.flatnonzero((self.keys[slot] != hashes) & (self.keys[slot] != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[todo]]
            todo = todo[(there != hashes[todo]) & (there != 0)]
        return slot

    def _store(self, buffers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Put ids into the pool; their places and sizes."""
        ids = np.frombuffer(b"".join(buffers), "<u4")
        sizes = np.fromiter(map(len, buffers), np.int64, len(buffers)) // 4
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        firsts = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + len(ids)] = ids
        self.used, self.entries = self.used + len(ids), self.entries + len(buffers)
        return firsts, sizes

    def _insert(self, hashes: np.ndarray, buffers: list[bytes], chars: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> None:
        """New distinct hashes with the ids and the characters of their pieces."""
        firsts, sizes = self._store(buffers)
        total = int(lengths.sum())
        while self.lettered + total > len(self.letters):
            self.letters = np.concatenate([self.letters, np.zeros(len(self.letters), np.uint16)])
        inside = np.cumsum(lengths) - lengths
        self.letters[self.lettered : self.lettered + total] = chars[np.repeat(start - inside, lengths) + np.arange(total)]
        spelled = self.lettered + inside
        self.lettered += total
        while len(hashes):
            slot = self._slots(hashes)
            self.keys[slot] = hashes  # of several for one free slot one stays
            own = self.keys[slot] == hashes
            self.first[slot[own]], self.size[slot[own]] = firsts[own], sizes[own]
            self.spelled[slot[own]], self.letters_of[slot[own]] = spelled[own], lengths[own]
            hashes, firsts, sizes, spelled, lengths = (x[~own] for x in (hashes, firsts, sizes, spelled, lengths))

    def _differs(self, chars: np.ndarray, start: np.ndarray, lengths: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Whether each piece is not the one that its slot holds; pieces cover ``chars``."""
        other = self.letters_of[slot] != lengths
        place = np.repeat(self.spelled[slot] - start, lengths) + np.arange(len(chars))
        wrong = np.flatnonzero(self.letters.take(place, mode="clip") != chars)
        other[np.searchsorted(start, wrong, "right") - 1] = True
        return other

    def _settled(self, texts: list[str]) -> list[bytes]:
        joined = _SEPARATOR.join(texts) + _SEPARATOR
        chars = np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), np.uint16)
        n = len(chars)
        _classes.grow(n + 1)
        kind = _classes.kind[chars]
        start = np.flatnonzero(piece_starts(chars, kind))
        end = np.append(start[1:], n)
        inner = kind[start] != _BORDER
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_classes.value[chars] * _classes.powers[:n], out=sums[1:])
        hashes = (sums[end] - sums[start]) * _classes.inverse[start]
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = (hashes ^ (hashes >> np.uint64(32))) | np.uint64(1)  # never the mark of a free slot
        lengths = end - start
        if self.entries > self.max_entries or self.lettered > self.MAX_LETTERS:
            self.clear()
        slot = self._slots(hashes)
        new = np.flatnonzero(inner & (self.keys[slot] == 0))
        text = lambda which: [joined[a:b] for a, b in zip(start[which].tolist(), end[which].tolist())]
        if len(new):
            distinct, at = np.unique(hashes[new], return_index=True)
            if self.entries + len(distinct) > self.max_entries:
                self.clear()
                new = np.flatnonzero(inner)
                distinct, at = np.unique(hashes[new], return_index=True)
            places = new[at]
            self._insert(distinct, self.encode(text(places)), chars, start[places], lengths[places])
            slot = self._slots(hashes)
        first, sizes = self.first[slot].astype(np.int64), np.where(inner, self.size[slot], 0)
        alike = np.flatnonzero(inner & self._differs(chars, start, lengths, slot))
        if len(alike):  # other pieces with the hash of a stored one
            pieces = text(alike)
            number = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
            which = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
            firsts, lens = self._store(self.encode(list(number)))
            first[alike], sizes[alike] = firsts[which], lens[which]
        ends = np.cumsum(sizes)
        where = np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1])
        data = self.pool[where].tobytes()
        cuts = (4 * ends[~inner]).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]

    def buffers(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as a little-endian unsigned 32-bit buffer."""
        out: list[bytes] = [b""] * len(texts)
        parts, owner, total = [], [], 0
        for i, text in enumerate(texts):
            if not is_settled(text):
                out[i] = b"".join(self.encode(split_pieces(text)))
                continue
            at = 0
            while at < len(text):
                # A very long text is cut before a blank that begins a word: pieces end there.
                cut = _CUT.search(text, at + SLICE) if len(text) - at > 2 * SLICE else None
                end = cut.start() if cut else len(text)
                parts.append(text[at:end])
                owner.append(i)
                at, total = end, total + end - at
                if total >= SLICE:
                    self._collect(parts, owner, out)
                    parts, owner, total = [], [], 0
        if parts:
            self._collect(parts, owner, out)
        return out

    def _collect(self, parts: list[str], owner: list[int], out: list[bytes]) -> None:
        for i, data in zip(owner, self._settled(parts)):
            out[i] = out[i] + data if out[i] else data


def slices(column: pa.Array, max_chars: int = SLICE) -> Iterator[tuple[int, list[str]]]:
    """Start and texts (null: empty) of runs of a column, each of about ``max_chars`` characters or one long text."""
    start, total, run = 0, 0, []
    for i, text in enumerate(column):
        run.append(text.as_py() or "")
        total += len(run[-1])
        if total >= max_chars:
            yield start, run
            start, total, run = i + 1, 0, []
    if run:
        yield start, run


def library_tokenizer(path: str):
    """The tokenizers library's encoder; strings of special tokens inside a text are ordinary text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


class LibraryEncoder:
    """Whole texts to ids with the tokenizers library.

    The library's model encodes each distinct piece once; texts with characters outside the settled blocks go to the
    library whole.
    """

    def __init__(self, path: str):
        self.tokenizer = library_tokenizer(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.table = PieceTable(self._pieces)
        # The library's alphabet: printable Latin-1 characters stand for themselves, other bytes for 256 and on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        tokenize, alphabet, out = self.tokenizer.model.tokenize, self.alphabet, []
        for piece in pieces:
            ids = [t.id for t in tokenize(piece.encode().decode("latin-1").translate(alphabet))]
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    def buffers(self, texts: list[str]) -> list[bytes]:
        out = self.table.buffers([t if is_settled(t) else "" for t in texts])
        for i, text in enumerate(texts):
            if not is_settled(text):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out[i] = np.array(ids, "<u4").tobytes()
        return out


_encoders: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def arrow_rows(batches: Iterable[pa.RecordBatch], text: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of record batches with their texts, each bounded in characters."""
    for batch in batches:
        for start, texts in slices(batch.column(text)):
            yield batch.slice(start, len(texts)), texts
