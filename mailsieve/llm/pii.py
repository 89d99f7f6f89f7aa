"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for what they miss.

The patterns find e-mail addresses, IP addresses, card numbers (Luhn) and international phone numbers; their spans always
stay. The field adds spans of the same kinds in other writings: phone numbers without a plus sign, ``name [at] host [dot]
org`` in any case and bracket, ``10[.]0[.]0[.]1``, card numbers with dots or wide gaps. It is trained on the driver from the small labelled table
below (digits drawn anew for each copy, seeded) and decoded by Viterbi over padded numpy batches, bucketed by length.

A word can only take part in an entity if it or a direct neighbour is *active*: holds a digit, an at sign or a bracketed
``at`` or ``dot`` of any case. All other words are outside by definition of the model, so a text splits exactly into chains of
words around the active ones, with known states at both ends, and texts without active words have no chain at all.

A span of the field counts if it does not overlap a pattern's span and passes the check of its kind: 13 to 19 digits and
Luhn, 7 to 15 digits, four parts up to 255, or an at sign before a dot.

Defined results: null and empty texts hold nothing; rows with the same or null ids are searched one by one; texts are
searched whole at any length, in linear time; an empty table gives no rows; other columns are ignored by ``find`` and
carried along unchanged by ``mask``.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mailsieve.llm.tokens import arrow_rows

KINDS = ("email", "ip", "card", "phone")
STATES = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

# The labelled table: entities in braces after their kind, 0 stands for any digit (cards: made to pass Luhn), ‹› for
# braces in the text.
LABELLED = """
call {phone (000) 000-0000} after nine
call me at {phone 000-000-0000} today
tel {phone 000.000.0000} or come by
phone {phone (000) 000 0000} please
her number is {phone 000 000 0000} now
fax: {phone (000) 000-0000}, office {phone 000-000-0000}.
reach us under {phone 0000 000000} at night
tel. {phone 0000/000000} im büro
Tel {phone 000-0000} ask for me
mobile {phone 000 000 00 00} merci
number {phone +0 (000) 000-0000} here
the old line {phone 0-000-000-0000} is dead
ring {phone 00 00 00 00 00} demain
und {phone (0000) 000000} nur abends
write to {email jane [at] example [dot] org} today
mail {email bob(at)example.org} or call
mail {email bob[at]example.org} or call
contact {email ann.lee (at) mail.example.com} now
by mail: {email sue (at) web [dot] example [dot] net} or so
e-mail {email tom00 [at] host0 [dot] example [dot] net} first
send it to {email kim@localhost [dot] org} soon
ask {email joe(at)example(dot)com} for it
escribe a {email ana [at] correo [dot] es} hoy
an {email max(at)beispiel.de} schreiben
the address {email sales@example[.]com} is new
write to {email jane [AT] example [DOT] org} today
mail {email bob(AT)example(DOT)com} or call
by mail: {email SUE [AT] WEB [DOT] EXAMPLE [DOT] NET} or so
send it to {email kim.lee (At) mail (Dot) example (Dot) net} first
contact {email ann ‹at› example ‹dot› org} now
reach {email tom00 ‹AT› host0 ‹DOT› example ‹DOT› net} soon
ask {email joe‹at›example‹dot›com} for it
mail {email bob‹AT›example.org} or call
write {email ann.lee-marie(at)mail.example(dot)net} or wait
mail {email mary-ann(at)example.org} today
contact {email joe_b(at)web-host.example(dot)org} for more
ask {email first.second.third-and-fourth.name_of_a_person(at)mail.department.example(dot)com} for it
server {ip 00[.]0[.]0[.]00} is down
from {ip 000[.]000[.]0[.]0} we saw
host {ip 000(.)00(.)00(.)0} answered
ping {ip 00 . 00 . 00 . 0} again
card {card 0000.0000.0000.0000} expires soon
pay with {card 0000  0000  0000  0000} now
carte {card 0000.0000.0000.0000} valide
visa {card 0000_0000_0000_0000} on file
two {card 0000 0000 0000 0000}, {card 0000.0000.0000.0000}
karte {card 0000/0000/0000/0000} bitte
Licensed under the Apache License, Version 0.0.
Licensed under CC BY-NC 0.0.
in 0000 there were 000 of them
it costs 00.00 or 0,000 each
on 00.00.0000 we met at 00:00
on 0000-00-00 we met
between 0000 and 0000 about 00 %
password=b0ce0a0fd000c0e0 stays
token = "0beb00b0af00000f0e00b0ad00cdbb0ae0f000ae" here
key AKIA0ABCD0EF00JDR is set
see page 00, line 0 of 000
chapter 0.0.0 of the book
room 000 on floor 0
scores were 0-0 and 00-00 then
order 000000 has shipped
number 00000000000000000000 is an id
the {ip 000.00.00.000} address
mail {email jane.00@mail0.example.com} today
number {card 0000000000000000} again
paid @ 00 each and @home
look (at) this or [at] that
a [dot] and a (dot) alone
we are (at) home [dot] that is all
look (AT) this or ‹at› that
a [DOT] and a ‹dot› alone
we are ‹AT› home (DOT) that is all
ISBN 000-0-000-00000-0 in print
version 0.00.000 of 0000
about 0 000 000 people in 0000
0 00 000 0000 00000
lat 00.0000 lon 00.0000 there
order placed 00 00 0000 by post
placed on 00 00 0000 and paid
dated 0 00 0000 in full
pages 000 000 000 000
pages 00 00 000 and 000 again
see pages 000 000 and 000
population 000 000 000
population of 0 000 000 in 0000
invoice 0000 000 0000
invoice 000 0000 of 0000
total 00 000 000 units
serial 000 0000 0000 in stock
from 0000 to 0000 and 00 to 00
between 000 and 000 pages
room 000-000 or 000/000 there
rows 0-00 and 00-000 of 000
""".strip().split("\n")

_ACTIVE = re.compile(r"[0-9@]|[\[({](?:at|dot|\.)[\])}]", re.IGNORECASE)
_AT = re.compile(r"@|[\[({]at[\])}]", re.IGNORECASE)
_MARK = re.compile(r"[\[({](?:at|dot)[\])}]", re.IGNORECASE)
_DOT = re.compile(r"\.|[\[({]dot[\])}]", re.IGNORECASE)
_WORDS = re.compile(r"\S+")
_ENTITY = re.compile(r"\{(\w+) ([^}]*)\}")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[^0-9]+")
#: Words whose presence beside a word is a feature of its own.
_CUES = frozenset("call tel phone fax mobile number ring card visa carte karte ip host server ping mail e-mail email contact version page chapter room order placed dated invoice population pages total serial rows from between isbn password token at".split())


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, from at sign to at sign, so that long runs are read once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start, found = at, None
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            done = found.end()
            out.append((start, done))
        at = text.find("@", done if found else at + 1)
    return out


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255


def _card_digits(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if _card_digits(_DIGITS.sub("", m[0]))]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    return out


def _shape(word: str) -> str:
    """Shape of the whole word: runs of letters are one letter, runs of over 20 digits are 20, marks are in lower case and no braces."""
    word = _MARK.sub(lambda m: m[0].lower().replace("{", "[").replace("}", "]"), word)
    shape = re.sub(r"[0-9]", "d", re.sub(r"[^\W\d_]", lambda m: "X" if m[0].isupper() else "x", word))
    return re.sub(r"d{21,}", "d" * 20, re.sub(r"x+", "x", re.sub(r"X+", "X", shape)))


def word_features(word: str) -> list[str]:
    """Shape features of one word; those of its neighbours are the same under other names."""
    core = word.rstrip(".,;:!?\"'")
    shape, digits = _shape(core), sum(c.isdigit() and c.isascii() for c in word)
    out = [f"s={shape}", f"f={re.sub('d+', 'd', shape)}", f"n={min(digits, 20)}", f"p={shape[:2]}", f"e={shape[-2:]}"]
    out += [f"a={bool(_ACTIVE.search(word))}", f"c={''.join(sorted(set(re.sub('[dxX]', '', shape))))}", f"end={core != word}"]
    if at := _AT.search(core):  # an address in one word, whatever its other marks
        out.append(f"m={0 < at.start() and at.end() < len(core)}{bool(_DOT.search(core, at.end()))}")
    if (low := core.strip("()[]{}.:").lower()) in _CUES or low == "dot":
        out.append(f"w={low}")
    return out


def chain_features(words: list[str]) -> list[list[str]]:
    own = [word_features(w) for w in words]
    return [
        [*f, *(f"-1{x}" for x in (own[i - 1] if i else ["edge"])), *(f"+1{x}" for x in (own[i + 1] if i + 1 < len(own) else ["edge"]))]
        for i, f in enumerate(own)
    ]


def _draw(sentence: str, rng: np.random.Generator) -> tuple[list[str], list[str]]:
    """A labelled sentence with digits drawn, half the time with other brackets or without one side: words and states."""
    if rng.integers(2):
        sentence = sentence.translate(str.maketrans("[]()", "()[]")) if "[" in sentence or "(at)" in sentence else sentence
    if "{" in sentence and (cut := rng.integers(4)) > 1:
        sentence = sentence[sentence.index("{") :] if cut == 2 else re.sub(r"(\}\S*).*$", r"\1", sentence)
    words, states, at = [], [], 0
    fill = lambda s: "".join(str(rng.integers(1, 10)) if c == "0" else c for c in s)

    def add(text, kind):
        for k, w in enumerate(text.split()):
            words.append(w.translate(str.maketrans("‹›", "{}")))
            states.append("O" if kind is None else f"{'BI'[k > 0]}-{kind}")

    for m in _ENTITY.finditer(sentence):
        add(fill(sentence[at : m.start()]), None)
        add(fill(m[2]), m[1])
        at = m.end()
        tail = re.match(r"\S+", sentence[at:])
        if tail:  # a mark that touches the entity belongs to its last word
            words[-1] += tail[0]
            at += tail.end()
    add(fill(sentence[at:]), None)
    return words, states


def active_runs(words: list[str]) -> list[tuple[int, int]]:
    """Ranges of words that hold an active word or touch one."""
    out: list[list[int]] = []
    for i, w in enumerate(words):
        if _ACTIVE.search(w):
            if out and out[-1][1] >= i - 1:
                out[-1][1] = min(len(words), i + 2)
            else:
                out.append([max(0, i - 1), min(len(words), i + 2)])
    return [(a, b) for a, b in out]


class ShapeField:
    """Linear-chain conditional random field: a weight for each feature and state, and for each pair of states."""

    def __init__(self, rounds: int = 120, copies: int = 10, penalty: float = 0.01, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.index: dict[str, int] = {}
        chains, gold = [], []
        for _ in range(copies):
            for sentence in LABELLED:
                words, states = _draw(sentence, rng)
                for a, b in active_runs(words):
                    chains.append(chain_features(self.framed(words, a, b))[1:-1])
                    gold.append([STATES.index(s) for s in states[a:b]])
        for features in chains:
            for f in features:
                for x in f:
                    self.index.setdefault(x, len(self.index))
        k = len(STATES)
        self.weights, self.links = np.zeros((len(self.index) + 1, k)), np.zeros((k, k))
        self.allowed = np.zeros((k, k))
        for b, s in enumerate(STATES):
            if s[0] == "I":  # goes on from the same kind only
                self.allowed[:, b] = -1e9
                self.allowed[[STATES.index("B" + s[1:]), b], b] = 0
        self._train(chains, gold, rounds, penalty)

    @staticmethod
    def framed(words: list[str], a: int, b: int) -> list[str]:
        """The chain's words with one more on either side, as their features see it."""
        return [words[a - 1] if a else "", *words[a:b], words[b] if b < len(words) else ""]

    def _train(self, chains, gold, rounds, penalty) -> None:
        """Gradient steps with per-weight rates on the exact likelihood, by forward and backward passes over all chains at once."""
        n, width, k = len(chains), max(map(len, chains)), len(STATES)
        most = max(len(f) for c in chains for f in c)
        ids = np.full((n, width, most), len(self.index))
        real, want = np.zeros((n, width), bool), np.zeros((n, width), int)
        for i, (c, g) in enumerate(zip(chains, gold)):
            for t, f in enumerate(c):
                ids[i, t, : len(f)] = [self.index[x] for x in f]
            real[i, : len(c)], want[i, : len(g)] = True, g
        sums = [np.full(self.weights.shape, 1e-8), np.full((k, k), 1e-8)]
        target = np.eye(k)[want] * real[..., None]
        follows = real[:, 1:]
        for _ in range(rounds):
            emit = self.weights[ids].sum(2)
            link = self.links + self.allowed
            start = emit[:, 0] + link[0]  # before the chain stands O
            forward = [start]
            for t in range(1, width):
                step = np.logaddexp.reduce(forward[-1][:, :, None] + link, axis=1) + emit[:, t]
                forward.append(np.where(real[:, t, None], step, forward[-1]))
            back = [link[:, 0] * np.ones((n, 1))]  # and after it O again
            for t in range(width - 1, 0, -1):
                step = np.logaddexp.reduce(link + (emit[:, t] + back[-1])[:, None, :], axis=2)
                back.append(np.where(real[:, t, None], step, back[-1]))
            back = back[::-1]
            total = np.logaddexp.reduce(forward[-1] + link[:, 0], axis=1)
            seen = np.stack([np.exp(f + b - total[:, None]) for f, b in zip(forward, back)], 1) * real[..., None]
            pairs = np.zeros((k, k))
            for t in range(1, width):
                p = np.exp(forward[t - 1][:, :, None] + link + (emit[:, t] + back[t])[:, None, :] - total[:, None, None])
                pairs += (p * real[:, t, None, None]).sum(0)
            last = real.sum(1) - 1
            each = np.arange(n)
            pairs[0] += seen[:, 0].sum(0)
            pairs[:, 0] += seen[each, last].sum(0)
            wanted = np.zeros((k, k))
            np.add.at(wanted, (want[:, :-1][follows], want[:, 1:][follows]), 1)
            np.add.at(wanted, (0, want[:, 0]), 1)
            np.add.at(wanted, (want[each, last], 0), 1)
            step = np.zeros_like(self.weights)
            np.add.at(step, ids.reshape(-1, most).T, (target - seen).reshape(-1, k))
            step[-1] = 0
            for value, change, total_sq in ((self.weights, step - penalty * self.weights, sums[0]), (self.links, wanted - pairs - penalty * self.links, sums[1])):
                total_sq += change**2
                value += 0.3 * change / np.sqrt(total_sq)
        self.links += self.allowed

    def emissions(self, features: list[list[str]]) -> np.ndarray:
        none = len(self.index)
        return np.array([self.weights[[self.index.get(x, none) for x in f]].sum(0) for f in features])

    def decode(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """Best states of each chain of emissions: one padded Viterbi for each length bucket."""
        out: list[np.ndarray] = [None] * len(chains)
        buckets = defaultdict(list)
        for i, c in enumerate(chains):
            buckets[(len(c) - 1).bit_length()].append(i)
        for members in buckets.values():
            for at in range(0, len(members), 2048):
                part = members[at : at + 2048]
                sizes = np.array([len(chains[i]) for i in part])
                emit = np.zeros((len(part), sizes.max(), len(STATES)))
                for row, i in enumerate(part):
                    emit[row, : sizes[row]] = chains[i]
                best, came = emit[:, 0] + self.links[0], []
                for t in range(1, emit.shape[1]):
                    ways = best[:, :, None] + self.links
                    inside = (t < sizes)[:, None]
                    came.append(np.where(inside, ways.argmax(1), np.arange(len(STATES))).astype(np.int8))
                    best = np.where(inside, ways.max(1) + emit[:, t], best)
                state = (best + self.links[:, 0]).argmax(1)
                path = [state]
                for step in reversed(came):
                    state = step[np.arange(len(part)), state]
                    path.append(state)
                path = np.array(path[::-1]).T
                for row, i in enumerate(part):
                    out[i] = path[row, : sizes[row]]
        return out


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    while end > start and text[end - 1] in ".,;:!?\"'>}":
        end -= 1
    while end > start and text[start] in "<\"'{":
        start += 1
    if text[start : start + 1] == "(" and ")" not in text[start:end]:
        start += 1
    return start, end


def _passes(kind: str, found: str) -> bool:
    digits = _DIGITS.sub("", found)
    if kind == "card":
        return _card_digits(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "ip":
        parts = [p for p in _DIGITS.split(found) if p]
        return len(parts) == 4 and all(map(_small, parts))
    at = _AT.search(found)
    return bool(at) and bool(_DOT.search(found, at.end()))


class Finder:
    """All spans of texts: patterns first, then what the field adds."""

    def __init__(self, field: ShapeField, max_words: int = 50_000):
        self.field, self.max_words, self.known = field, max_words, {}

    def _own(self, word: str) -> list[str]:
        if len(word) > 200:  # seldom seen again, and its features are as long
            return word_features(word)
        if word not in self.known:
            if len(self.known) >= self.max_words:
                self.known.clear()
            self.known[word] = word_features(word)
        return self.known[word]

    def _emissions(self, framed: list[str]) -> np.ndarray:
        own = [self._own(w) for w in framed]
        index, none = self.field.index, len(self.field.index)
        rows = []
        for i in range(1, len(own) - 1):
            # Beyond the first and last word of a frame there is nothing, as in training.
            ids = [index.get(x, none) for x in own[i]]
            ids += [index.get(f"-1{x}", none) for x in own[i - 1]] + [index.get(f"+1{x}", none) for x in own[i + 1]]
            rows.append(self.field.weights[ids].sum(0))
        return np.array(rows)

    def spans(self, texts: list[str]) -> list[tuple[list, list]]:
        """For each text the pattern spans and the spans that the field adds."""
        out, chains, places = [], [], []
        for n, text in enumerate(texts):
            if not _ACTIVE.search(text):
                out.append(([], []))
                continue
            out.append((pattern_spans(text), []))
            found = list(_WORDS.finditer(text))
            words = [m[0] for m in found]
            for a, b in active_runs(words):
                chains.append(self._emissions(ShapeField.framed(words, a, b)))
                places.append((n, [m.span() for m in found[a:b]]))
        for (n, spots), states in zip(places, self.field.decode(chains)):
            at = 0
            while at < len(states):
                if STATES[states[at]][0] != "B":
                    at += 1
                    continue
                end = at + 1
                while end < len(states) and STATES[states[end]] == "I" + STATES[states[at]][1:]:
                    end += 1
                kind, (start, stop) = STATES[states[at]][2:], _trim(texts[n], spots[at][0], spots[end - 1][1])
                if _passes(kind, texts[n][start:stop]):
                    out[n][1].append((kind, start, stop))
                at = end
        return [(base, self._free(base, added)) for base, added in out]

    @staticmethod
    def _free(base: list, added: list) -> list:
        taken = sorted((a, b) for _, a, b in base)
        kept, i = [], 0
        for kind, a, b in sorted(added, key=lambda s: s[1]):
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            # Spans of different kinds may overlap, so all that begin before the end are looked at.
            if not any(a < e for _, e in takewhile(lambda t: t[0] < b, islice(taken, i, None))):
                kept.append((kind, a, b))
        return kept


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


@functools.cache
def standard_field() -> ShapeField:
    """The field of the labelled table, fitted once for each process."""
    return ShapeField()


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", field: ShapeField | None = None) -> DataFrame:
    """One row per text: counts and digest of the pattern spans, and all spans."""
    field = field or standard_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(field)
        for part, texts in arrow_rows(batches):
            found = finder.spans(texts)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            every = [joined(base + added) for base, added in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *counts, pa.array(digests, pa.string()), pa.array(every, pa.string())],
                ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(docs[id_column], docs[text_column]).mapInArrow(run, schema).withColumnsRenamed({"id": id_column})


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, as the first one's kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text_column: str = "text", field: ShapeField | None = None) -> DataFrame:
    """The same rows and columns with personal data replaced in the text; nulls stay."""
    field = field or standard_field()
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(field)
        for part, texts in arrow_rows(batches, place):
            there = part.column(place).is_valid().to_pylist()
            clean = [masked(t, base + added) if ok else None for ok, t, (base, added) in zip(there, texts, finder.spans(texts))]
            yield part.set_column(place, part.schema.field(place), pa.array(clean, part.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
