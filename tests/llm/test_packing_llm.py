"""Packing: every id once, gapless windows, checksums, little padding, related neighbours."""

import zlib
from collections import defaultdict

import numpy as np

from mailsieve.llm import packing
from mailsieve.llm.queries import VOCABULARY, op10_bm25_packing
from mailsieve.llm.tokens import library_tokenizer, vocabulary_path

from .helpers import AWKWARD, DOCS, WORDS, awkward, crowded, rows_of

PATH = vocabulary_path(VOCABULARY)


def check(rows, texts, window=1024):
    """Share of padding; asserts all else. ``texts``: (id, text) with ids that may repeat."""
    tokenizer = library_tokenizer(PATH)
    ids = defaultdict(list)
    for i, t in texts:
        ids[i].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])
    covered, windows = defaultdict(int), defaultdict(list)
    for r in rows:
        crc = lambda x: zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes())
        assert any(len(x) == r.doc_tokens and crc(x) == r.ids_crc32 for x in ids[r.doc_id])
        covered[r.doc_id] += r.length
        windows[r.sequence_id].append(r)
    assert covered == {i: sum(map(len, xs)) for i, xs in ids.items()}
    used = 0
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        used += at
    for i, xs in ids.items():
        if len(xs) == 1:
            own = sorted((r.start, r.length) for r in rows if r.doc_id == i)
            assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0
    return 1 - used / max(1, window * len(windows))


def test_awkward_rows(spark):
    texts = [(r[0], r[1]) for r in AWKWARD]
    check(packing.pack(awkward(spark), PATH).collect(), texts)
    check(packing.pack(crowded(awkward(spark)), PATH).collect(), texts)
    assert packing.pack(spark.createDataFrame([], DOCS), PATH).collect() == []


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = op10_bm25_packing(spark, sf_dir).collect()
    assert check(rows, docs) < 0.02
    assert rows_of(op10_bm25_packing(spark, sf_dir)) == sorted(map(tuple, rows), key=repr)


def test_hot_token_spreads_over_shards(spark):
    docs = spark.createDataFrame([(i, "same words again and again") for i in range(600)], "doc_id bigint, text string")
    rows = packing.pack(docs, PATH, shard_rows=64).collect()
    check(rows, [(i, "same words again and again") for i in range(600)])
    assert len({r.sequence_id // 2 >> 32 for r in rows}) > 8


def brute_scores(ids, idf, mean, seed, k1=1.2, b=0.75):
    weight = lambda t, x: idf[t] * x.count(t) * (k1 + 1) / (x.count(t) + k1 * (1 - b + b * len(x) / mean)) if t in x else 0.0
    return [sum(weight(t, x) for t in sorted(set(ids[seed]))) for x in ids]


def random_shard(seed, rows=50):
    rng = np.random.default_rng(seed)
    ids = [rng.integers(0, 60, rng.integers(5, 40)).tolist() for _ in range(rows)]
    idf = rng.random(60) + 0.1
    return ids, idf, packing.Shard([np.array(x) for x in ids], idf, 20.0)


def test_neighbours_follow_bm25():
    ids, idf, shard = random_shard(1)
    for seed in range(50):
        scores = np.array(brute_scores(ids, idf, 20.0, seed))
        order = shard.neighbours(seed)
        assert np.allclose(scores[order], np.sort(scores)[::-1])
    shard.alive[order[:10]] = False
    assert not set(shard.neighbours(0)) & set(order[:10])


def brute_windows(ids, idf, mean, window, min_piece):
    """The greedy packing of one shard, scores of all rows from scratch for each window."""
    left, windows = [len(x) for x in ids], []
    for seed in range(len(ids)):
        while left[seed]:
            room, pieces, row = window, [], seed
            scores = brute_scores(ids, idf, mean, seed)
            while row is not None:
                take = min(room, left[row])
                pieces.append((row, len(ids[row]) - left[row], take))
                left[row] -= take
                room -= take
                order = sorted((r for r in range(len(ids)) if left[r]), key=lambda r: (-round(scores[r], 9), r))
                whole = [r for r in order if left[r] <= room]
                row = None if not room else whole[0] if whole else order[0] if room >= min_piece and order else None
            windows.append(pieces)
    return windows


def test_windows_are_those_of_a_plain_search():
    for seed in range(4):
        ids, idf, shard = random_shard(seed, 80)
        got = defaultdict(list)
        for row, first, size, number, offset in packing.pack_shard([np.array(x) for x in ids], shard, 64, 8):
            assert offset == sum(p[2] for p in got[number])
            got[number].append((row, first, size))
        assert [got[n] for n in sorted(got)] == brute_windows(ids, idf, 20.0, 64, 8)


def test_statistics_cover_all_pieces(spark):
    """Also full windows count, and texts of a multiple of the window, which have no tail."""
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(rng.choice(WORDS, rng.integers(0, 200)))) for i in range(60)] + [(90, None), (91, "old " * 31)]
    cut = packing.cut_texts(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5), PATH, 16, 0, "doc_id", "text")
    tokenizer, want, pieces = library_tokenizer(PATH), defaultdict(int), 0
    for _, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for start in range(0, len(ids), 16):
            pieces += 1
            for token in set(ids[start : start + 16]):
                want[token] += 1
    got = packing.piece_frequencies(cut.filter("start = -1"), tokenizer.get_vocab_size() + 1)
    assert {t: got[t] for t in np.flatnonzero(got)} == want
    assert cut.filter("start >= 0").count() == pieces


def test_cut_rest_stays_unused():
    ids = [np.full(70, k) for k in range(5)]
    shard = packing.Shard(ids, np.ones(10), 70.0)
    pieces = list(packing.pack_shard(ids, shard, 100, 8))
    assert sum(p[2] for p in pieces) == 350
    assert [sum(p[2] for p in pieces if p[3] == w) for w in (1, 2, 3)] == [100, 100, 100]
