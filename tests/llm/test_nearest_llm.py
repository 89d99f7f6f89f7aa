"""Nearest neighbours against all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve.llm import nearest

from .helpers import rows_of

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, step, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for i, q in good:
        if i % step == 0:
            scores = []
            for j, c in good:
                if j != i and len(c) == len(q):
                    s = 0.0
                    for x, y in zip(q, c):
                        s += x * y
                    scores.append((-s, j))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def search(df, step=5, k=4, **sizes):
    return nearest.search(df, F.col("id") % step == 0, "vec_id", "embedding", k, **sizes)


@pytest.mark.parametrize("rows, group", [(1024, 8), (7, 2), (1, 1)])
def test_random_vectors_with_ties(spark, rows, group):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=8).astype(np.float32).tolist(), 0) for i in range(60)]
    data += [(100 + i, data[3][1], 0) for i in range(30)]  # equal scores
    data += [(200 + i, rng.integers(-2, 3, 8).astype(float).tolist(), 0) for i in range(30)]
    df = spark.createDataFrame(data, VECTORS).repartition(3)
    assert rows_of(search(df, rows=rows, group_chunks=group)) == brute(data, 5, 4)


def test_awkward_rows(spark):
    data = [
        (0, [1.0, 0.0], 0), (5, None, 0), (10, [], 0), (15, [0.0, 0.0], 0), (20, [float("nan"), 1.0], 0), (25, [float("inf"), 1.0], 0),
        (30, [None, 1.0], 0), (1, [0.5, 0.5], None), (2, [1e-30, -1e-30], 0), (3, [1e30, 1.0], 0), (4, [1.0, 2.0, 3.0], 0), (None, [1.0, 1.0], 0),
        (35, [1.0], 0),
    ]
    df = spark.createDataFrame(data, VECTORS)
    want = brute(data, 5, 4)
    assert rows_of(search(df)) == want and {r[0] for r in want} == {0}
    clash = df.selectExpr("*", "1 as id", "2 as v", "3 as chunk", "4 as dim", "5 as score")
    assert rows_of(search(clash)) == want
    assert search(spark.createDataFrame([], VECTORS)).collect() == []


def test_repeated_rows(spark):
    data = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (1, [0.5, 0.1], 0), (1, [0.5, 0.1], 0), (2, [0.4, 0.0], 0)]
    got = rows_of(search(spark.createDataFrame(data, VECTORS)))
    assert [r[:3] for r in got] == [(0, 1, 1)] * 2 + [(0, 2, 1)] * 2 + [(0, 3, 2)] * 2


def test_bounds_hold():
    rng = np.random.default_rng(4)
    for scale in (1e-6, 1.0, 1e6):
        a, b = ((rng.normal(size=(40, 16)) * scale).astype(np.float32) for _ in range(2))
        q, c = (nearest.Coded(np.arange(s, s + 40).astype("<i8").tobytes(), x.tobytes(), 16) for s, x in ((0, a), (100, b)))
        rows, columns, score = nearest.tile(q, c, np.full(40, -np.inf), 5)
        exact = a.astype(float) @ b.astype(float).T
        assert np.allclose(score, exact[rows, columns])
        best = np.argsort(-exact, 1)[:, :5]
        assert {(i, j) for i in range(40) for j in best[i]} <= set(zip(rows.tolist(), columns.tolist()))
        assert len(rows) < 40 * 40 * 0.8


def test_doubles_beyond_the_range_of_squares(spark):
    rng = np.random.default_rng(9)
    kinds = "vec_id bigint, embedding array<double>, label int"
    for size in (1e160, 1e-170, 1e150):
        data = [(i, (size * rng.normal(size=4)).tolist(), 0) for i in range(40)]
        df = spark.createDataFrame(data, kinds)
        got = [tuple(r) for r in nearest.search(df, F.col("id") % 5 == 0, "vec_id", "embedding", 4).orderBy("query_id", "rank").collect()]
        want = []
        for i, q, _ in data[::5]:
            scored = []
            for j, c, _ in data:
                if j != i:
                    s = 0.0
                    for x, y in zip(q, c):
                        s += x * y
                    scored.append((-(s if s == s else -math.inf), j, s))
            want += [(i, n + 1, j, s) for n, (_, j, s) in enumerate(sorted(scored, key=lambda x: x[:2])[:4])]
        assert repr(got) == repr(want)


def test_no_side_is_sent_through_the_driver(spark):
    """The copies of query chunks for all groups are not in the estimate that a broadcast is chosen by."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist(), 0) for i in range(40)], VECTORS)
    assert "Broadcast" not in search(df, rows=2, group_chunks=1)._jdf.queryExecution().executedPlan().toString()
