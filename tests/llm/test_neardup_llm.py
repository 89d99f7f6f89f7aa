"""Near duplicates against all pairs of full sets."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from mailsieve.llm import neardup
from mailsieve.llm.queries import op2_bbit_minhash

from .helpers import AWKWARD, DOCS, WORDS, awkward, crowded, rows_of


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    """id -> (set size, component), ids distinct."""
    sets, holders, up = {i: shingles(t) for i, t in docs}, defaultdict(list), {}
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)

    def root(x):
        while x in up:
            x = up[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n) and (a := root(i)) != (b := root(j)):
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def family(rng, n, words, changes, start):
    """A text and copies with some words changed, as (id, text)."""
    source = [rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(words)]
    out = []
    for k in range(n):
        copy = list(source)
        for _ in range(rng.randint(0, changes)):
            copy[rng.randrange(words)] = "changed%d" % rng.randint(0, 9)
        out.append((start + k, " ".join(copy)))
    return out


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("words, changes", [(120, 6), (60, 4), (12, 1)])
def test_families(spark, words, changes):
    rng = random.Random(words)
    docs = [d for f in range(12) for d in family(rng, 25, words, changes, 100 * f)]
    docs += [(5000 + k, docs[0][1].upper()) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert found(neardup.near_duplicates(df)) == brute(docs)
    assert found(neardup.near_duplicates(df, tile_rows=8)) == brute(docs)


def test_awkward_rows(spark):
    want = [
        (1, 0, 1, True), (2, 0, 2, True), (3, 2, 3, True), (4, 2, 3, False), (4, 2, 3, False), (7, 0, 7, True),
        (8, 2, 8, True), (9, 1, 9, True), (10, 1, 10, True), (None, 2, None, True),
    ]
    want[6] = (8, len(shingles(AWKWARD[7][1])), 8, True)
    assert rows_of(neardup.near_duplicates(awkward(spark))) == sorted(want, key=repr)
    assert rows_of(neardup.near_duplicates(crowded(awkward(spark)))) == sorted(want, key=repr)
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_one_of_each(spark):
    rows = neardup.one_of_each(awkward(spark))
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id for r in rows.collect()), key=repr) == sorted([1, 2, 3, 7, 8, 9, 10, None], key=repr)


def test_short_texts_are_no_part_of_long_ones(spark):
    docs = [(1, "a b c d"), (2, "a b c d"), (3, "a b c d e"), (4, "A B C D"), (5, "a b  c\td")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert found(neardup.near_duplicates(df)) == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 1), 5: (1, 1)}


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(2)
    signer = neardup.Signer()
    for share in (0.0, 0.5, 0.9):
        estimates = []
        for _ in range(60):
            a = rng.integers(0, 1 << 63, 400, np.uint64)
            b = np.concatenate([a[: int(400 * share)], rng.integers(0, 1 << 63, 400 - int(400 * share), np.uint64)])
            planes = [np.frombuffer(signer.planes(signer.minima(x)), np.uint64)[None] for x in (a, b)]
            estimates.append(neardup.similarity(neardup.equal_groups(*planes, signer.n), signer.n)[0, 0])
        assert abs(np.mean(estimates) - share / (2 - share)) < 0.03


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300)]
    got = {r.node: r.component for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {200: 100, 300: 100}


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(op2_bbit_minhash(spark, sf_dir)) == brute(docs)
