"""Importance resampling against plain counting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve.llm import resample as R
from mailsieve.llm.queries import op12_crc_resampling

from .helpers import awkward, crowded, rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text):
    words = WORD.findall((text or "").translate(_LOWER))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=5, buckets=10_000, seed=42, min_words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    found = [(i, *runs(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, fs in found:
        s.update(map(bucket, fs))
    for text in target:
        t.update(map(bucket, runs(text)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    rows = []
    for i, words, fs in found:
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = Counter()
    drawn = [(r[0], r[2], r[3], r[4], n + 1) for n, r in enumerate(able[: percent * len(able) // 100])]
    for r in drawn:
        rank[r[:4]] += 1
    rest = []
    for i, _, n, weight, score in rows:
        if rank[i, n, weight, score]:
            rank[i, n, weight, score] -= 1
        else:
            rest.append((i, n, weight, score, None))
    return sorted(drawn + rest, key=repr)


def test_checksums():
    rng = np.random.default_rng(1)
    for length in (1, 2, 7, 300):
        rows = rng.integers(0, 256, (50, length)).astype(np.uint8)
        assert R.crc32_rows(rows.T).tolist() == [zlib.crc32(r.tobytes()) for r in rows]
    stream = rng.integers(0, 256, 30_000).astype(np.uint8).tobytes()
    begin, length = rng.integers(0, 20_000, 500), rng.integers(1, 60, 500)
    length[:3] = 5_000
    assert R.stretch_crcs(stream, begin, length).tolist() == [zlib.crc32(stream[b : b + n]) for b, n in zip(begin, length)]


@pytest.mark.parametrize("words, size", [(1 << 17, 1 << 22), (5, 1 << 22), (3, 16), (1, 1)])
def test_buckets_in_blocks(monkeypatch, words, size):
    monkeypatch.setattr(R, "BLOCK_WORDS", words)
    monkeypatch.setattr(R, "BLOCK_BYTES", size)
    rng = random.Random(2)
    letters = "abAB  .\n-é漢\x00\x7f09Ö'"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(150))) for _ in range(200)] + ["", " . ", "one", "a b", "a A a a", "x" * 9000 + " y"]
    n_words, found = R.text_buckets(texts, 997)
    for text, n, data in zip(texts, n_words.tolist(), found):
        w, fs = runs(text)
        assert n == len(w)
        assert sorted(np.frombuffer(data, "<u2").tolist()) == sorted(zlib.crc32(f.encode()) % 997 for f in fs)


def test_awkward_rows(spark):
    docs = awkward(spark)
    target = spark.createDataFrame([("One two three",), (None,), ("",), ("no id at all",)], "text string")
    options = dict(percent=60, buckets=50, min_words=3)
    got = rows_of(R.resample(docs, target, **options))
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], ["One two three", None, "", "no id at all"], **options)
    assert got == want and any(r[4] for r in got)
    clash = docs.withColumns({n: F.lit("clash") for n in ("id", "row", "rank", "weight", "buckets", "n_words", "_key", "_m")})
    assert rows_of(R.resample(clash, target, **options)) == want
    assert rows_of(R.resample(crowded(docs), target, **options)) == want
    assert R.resample(docs.limit(0), target).collect() == []
    assert rows_of(R.resample(docs, target.limit(0), **options)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [], **options)


def test_repeated_ids_and_cut(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    data = [(i % 400, " ".join(rng.choices(words, k=25))) for i in range(900)] + [(5, "same words here " * 10)] * 300
    docs = spark.createDataFrame(data, "doc_id bigint, text string").repartition(5)
    target = spark.createDataFrame([(" ".join(words[:9]),)], "text string")
    for percent in (1, 30, 100):
        assert rows_of(R.resample(docs, target, percent=percent)) == brute(data, [" ".join(words[:9])], percent)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert rows_of(op12_crc_resampling(spark, sf_dir)) == brute([tuple(r) for r in docs], target)
