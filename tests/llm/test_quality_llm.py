"""Base counts against plain Python, the estimator against numpy."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from mailsieve.llm import oracle, quality
from mailsieve.llm.queries import op3_robust_outliers

from .helpers import AWKWARD, DOCS, WORDS, awkward, crowded, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), failed


def counts(df):
    return rows_of(df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))


def test_awkward_rows(spark):
    want = sorted(((r[0], *base(r[1])) for r in AWKWARD), key=repr)
    judged = quality.judge(awkward(spark))
    assert counts(judged) == want
    assert judged.filter("kept").count() == 0
    assert counts(quality.judge(crowded(awkward(spark)))) == want
    assert quality.judge(spark.createDataFrame([], DOCS)).collect() == []


def test_random_repeats(spark):
    rng = random.Random(8)
    texts = []
    for i in range(300):
        parts = [" ".join(rng.choices("abcd", k=rng.randint(1, 12))) for _ in range(rng.randint(1, 9))]
        texts.append((i, rng.choice(["\n", " ", "\t\r\n", "\x0b"]).join(rng.choices(parts, k=rng.randint(1, 14)))))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS)
    assert counts(quality.judge(df)) == sorted(((i, *base(t)) for i, t in texts), key=repr)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(n))


def test_outliers_go_and_prose_stays(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(30, 200)), "en", f"s{i % 3}", 0) for i in range(600)]
    noisy = [(1000 + i, " ".join(f"{rng.choice(WORDS)}$$$%%%" for _ in range(60)), "en", f"s{i % 3}", 0) for i in range(30)]
    rows += [(2000 + i, rows[0][1], "en", "s0", 0) for i in range(900)]  # copies are not what is usual
    df = spark.createDataFrame(rows + noisy, DOCS)
    verdict = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    assert not any(verdict[i] for i, *_ in noisy)
    assert all(verdict[i] for i, *_ in rows)


def test_small_groups_share_and_tiny_ones_keep(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 60), "en", f"s{i}", 0) for i in range(80)] + [(500, " ".join(["$$$$$$%%%%%%"] * 3 + prose(rng, 30).split()) + " $%$%$%" * 20, "en", None, 0)]
    rows += [(600 + i, prose(rng, 60), None, None, 0) for i in range(5)]
    verdict = {r.doc_id: (r.kept, r.distance) for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert not verdict[500][0] and all(verdict[i][0] for i in range(80))
    assert all(verdict[600 + i] == (True, None) for i in range(5))


def test_texts_weigh_not_vectors(spark):
    """One distribution at several sizes: many clean texts share few vectors, the bad ones all differ."""
    rng = random.Random(12)

    def clean(i):  # of 20 words, up to 19 have a longer ending: 20 vectors in all
        words = [f"{rng.choice('abcdefgh')}{rng.choice('klmnop')}{i:06d}{k:02d}" for k in range(20)]
        return " ".join(w + "x" * (k < i % 20) for k, w in enumerate(words))

    def bad(i):  # 10 to 40 % symbols, another share in each text
        words = [f"w{i:04d}{k:03d}" for k in range(40 + i % 50)]
        return " ".join(words) + " " + "$" * (len("".join(words)) * (110 + i) // 1000)

    for size in (100, 400, 1600):
        rows = [(i, clean(i), "en", "s", 0) for i in range(size)] + [(10_000 + i, bad(i), "en", "s", 0) for i in range(size // 5)]
        verdict = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
        assert all(verdict[i] for i in range(size)), size
        assert not any(verdict[10_000 + i] for i in range(size // 5)), size


def faulty_group(size):
    """Clean texts with words of one length and many equal vectors; by id: signs, repeated lines, repeated passages."""
    rng = random.Random(size)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = [(i, "\n".join(" ".join(word() for _ in range(6)) for _ in range(5 + i % 9))) for i in range(size)]
    rows += [(10_000 + i, " ".join(word() for _ in range(60)) + " " + "$%#" * (20 + i)) for i in range(size // 25)]
    for first, share in ((20_000, 43), (30_000, 28)):
        for i in range(20):
            lines = [" ".join(word() for _ in range(6)) for _ in range(40 - 40 * share // 100)]
            rows.append((first + i, "\n".join(lines + lines[: 40 * share // 100])))
    for i in range(20):  # 144 of 600 words in passages that come twice; of 200 words, 48 are too few to tell
        words = [word() for _ in range(528)]
        rows.append((40_000 + i, " ".join(words[:72] + words)))
    return [(i, t, "en", "s", 0) for i, t in rows]


def test_repeats_and_signs_go_from_a_uniform_group(spark):
    for size in (300, 1500):
        verdict = {r.doc_id: (r.kept, r.judged_by) for r in quality.judge(spark.createDataFrame(faulty_group(size), DOCS)).collect()}
        assert all(v == (True, "source") for i, v in verdict.items() if i < 10_000)
        assert not any(v[0] for i, v in verdict.items() if i >= 10_000)


def test_twin_agrees_where_texts_share_vectors(spark, tmp_path):
    rows = faulty_group(400) + [(50_000 + i, prose(random.Random(i), 25 + i), "fr", f"s{i % 4}", 0) for i in range(120)]
    rows += [(60_000 + i, prose(random.Random(i), 40), None, "s", 0) for i in range(30)] + [(None, None, None, None, None), rows[0]]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    answer = con.execute(oracle.ORACLE["op3_robust_outliers"])
    names = [d[0] for d in answer.description]
    got = op3_robust_outliers(spark, str(tmp_path)).select(*names)
    assert rows_of(got) == sorted(answer.fetchall(), key=repr)
    assert {r.judged_by for r in got.collect()} == {"source", "language", "none", "base"}


def numpy_mcd(x, floors, support, steps):
    """The same estimator on one group of distinct integer vectors, and the root of the smallest determinant by start."""
    floor = np.diag(np.array(floors) ** 2)

    def quantile(v, q):
        v = np.sort(v)
        at = q * (len(v) - 1)
        return v[int(at)] + (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]) * (at - int(at))

    def squared(m, c):
        return np.einsum("ij,jk,ik->i", x / quality.STEP - m, np.linalg.inv(c), x / quality.STEP - m)

    def estimate(part, grow):
        return part.mean(0), grow * np.cov(part.T, bias=True) + floor

    middle = np.array([quantile(x[:, i], 0.5) for i in range(4)])
    spread = np.array([max(1.4826 * quantile(abs(x[:, i] - middle[i]), 0.5) / quality.STEP, floors[i]) for i in range(4)])
    m = middle / quality.STEP
    d = squared(m, np.diag(spread**2))
    turned = np.rint((x / quality.STEP - m) / spread / np.sqrt(d)[:, None] * quality.STEP) / quality.STEP
    near = np.rint(256 * np.log1p(d))
    starts = [
        (m, np.diag(spread**2)), (m, 4 * np.cov(turned.T, bias=True) * np.outer(spread, spread) + floor),
        estimate(x[near <= quantile(near, 0.5)] / quality.STEP, 1.0),
    ]
    ends = []
    for m, c in starts:
        volume = np.inf
        for _ in range(steps):
            rounded = np.rint(256 * np.log1p(squared(m, c)))
            after = estimate(x[rounded <= quantile(rounded, support)] / quality.STEP, quality.GROW_75)
            if not np.sqrt(np.linalg.det(after[1])) < volume * (1 - quality.FALL):
                break
            (m, c), volume = after, np.sqrt(np.linalg.det(after[1]))
        ends.append((volume, m, c))
    _, m, c = min(ends, key=lambda end: end[0])
    return *estimate(x[squared(m, c) <= quality.CHI_975] / quality.STEP, quality.GROW_975), [end[0] for end in ends]


def test_estimate_is_the_same_in_numpy(spark):
    floors = (0.05, 0.02, 0.03, 0.04)
    groups, several = {}, 0
    for seed in range(6):
        rng = np.random.default_rng(seed)
        mix = rng.normal(size=(4, 4)) * 0.1
        x = np.rint((rng.normal(size=(500, 4)) @ mix + [1.5, 0.3, 0.4, 0.5]) * quality.STEP).astype(int)
        x[: 60 + 20 * seed] += np.rint(rng.normal(size=4) * quality.STEP).astype(int)
        groups[f"g{seed}"] = np.unique(x, axis=0)
    rows = [(g, *map(int, r)) for g, x in groups.items() for r in x]
    df = spark.createDataFrame(rows, "group string, x0 bigint, x1 bigint, x2 bigint, x3 bigint")
    for got in quality.fit_mcd(df, floors, 0.75, 30).collect():
        m, c, volumes = numpy_mcd(groups[got.group], floors, 0.75, 30)
        several += len({round(v, 12) for v in volumes}) > 1
        assert np.allclose([got[f"m_{i}"] for i in range(4)], m)
        assert np.allclose([got[f"v_{i}_{j}"] for i in range(4) for j in range(i + 1)], c[np.tril_indices(4)])
    assert several  # starts that end elsewhere: the smallest determinant matters


def test_distance_of_one_document(spark):
    """The distance as one expression equals that by numpy, counting error included."""
    rng = np.random.default_rng(3)
    floors = (0.08, 0.04, 0.06, 0.06)
    a = rng.normal(size=(4, 4)) * 0.2
    c, m, x = a @ a.T + np.diag(np.array(floors) ** 2), rng.normal(size=4), rng.integers(-5000, 5000, 4)
    row = {f"v_{i}_{j}": float(c[i, j]) for i in range(4) for j in range(i + 1)} | {f"m_{i}": float(m[i]) for i in range(4)}
    row |= {f"x{i}": int(x[i]) for i in range(4)} | {"n_words": 30, "word_chars": 200, "n_lines": 7}
    own = c + np.diag([0.3 / 30, 0.25 / 200, 0.25 / 7, 2 / 30])
    off = x / quality.STEP - m
    got = spark.createDataFrame([row]).select(quality._own_distance(floors)).first()[0]
    assert np.isclose(got, off @ np.linalg.inv(own) @ off)


def test_query_is_native(spark, sf_dir):
    df = op3_robust_outliers(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert counts(df) == sorted(((r.doc_id, *base(r.text)) for r in docs), key=repr)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.filter(F.col("base_failed") & F.col("kept")).count() == 0
