"""Hard negatives against all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve.llm import negatives

from .helpers import rows_of

VECTORS = "vec_id bigint, embedding array<double>, label int"


def brute(rows, step=10, k=5, share=80, scale=256):
    good = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in v):
            w = [math.floor(scale * x) for x in v]
            if sum(x * x for x in w) < 2**63:
                good.append((i, w, label))
    out = []
    for i, q, label in good:
        if i % step == 0:
            scored = [(-sum(x * y for x, y in zip(q, c)), j, other) for j, c, other in good if len(c) == len(q)]
            for s, j in sorted((s, j) for s, j, other in scored if other == label and j != i)[:k]:
                found = sorted((n, x) for n, x, other in scored if other != label and share * -s <= 100 * -n <= 100 * -s)[:k]
                out += [(i, j, r + 1, x, -s, -n) for r, (n, x) in enumerate(found)]
    return sorted(out, key=repr)


def mine(df, step=10, **options):
    return negatives.mine(df, F.col("id") % step == 0, "vec_id", "embedding", "label", **options)


@pytest.mark.parametrize("sizes", [{}, {"chunk_rows": 40, "block_rows": 3, "group_chunks": 2}, {"chunk_rows": 1, "group_chunks": 50, "sample": 5}])
def test_ties_and_hot_vectors(spark, sizes):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=6).round(2).tolist(), int(rng.integers(3))) for i in range(150)]
    data += [(200 + i, data[10][1], i % 2) for i in range(60)]  # one vector in many rows
    data += [(300 + i, rng.integers(-1, 2, 6).astype(float).tolist(), i % 3) for i in range(60)]
    data += [(400, data[10][1], 0)] * 8 + [(410, [0.0] * 6, 1)]
    df = spark.createDataFrame(data, VECTORS).repartition(3)
    assert rows_of(mine(df, **sizes)) == brute(data)


def test_large_table_of_clustered_rows(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    data = [(i, (centres[i % 12] + 0.3 * rng.normal(size=16)).tolist(), int(rng.integers(4))) for i in range(2500)]
    df = spark.createDataFrame(data, VECTORS).repartition(4)
    assert rows_of(mine(df, 25)) == brute(data, 25)


def test_awkward_rows(spark):
    big = float(2**22)
    data = [
        (0, [1.0, 0.5], 0), (1, [0.9, 0.5], 0), (2, [0.9, 0.4], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1),
        (7, [0.9, 0.4], None), (None, [0.9, 0.4], 1), (8, [1.0, 0.5, 0.0], 1), (10, [], 0), (11, [], 0), (12, [], 1), (20, [-1.0, 0.0], 2), (21, [1.0, 0.0], 2),
        (30, [big, big], 3), (31, [big, big], 3), (32, [big, big - 1 / 256], 4), (33, [1e300, 1.0], 4), (34, [1.7e308, 1.0], 4), (40, [3.0], 5), (50, [0.0, 0.0], 6),
        (51, [0.3, 0.0], 6), (1, [0.9, 0.5], 0), (2, [0.9, 0.4], 1),
    ]
    df = spark.createDataFrame(data, VECTORS)
    want = brute(data)
    assert rows_of(mine(df)) == want and {r[0] for r in want} >= {0, 10, 30, 50}
    clash = df.selectExpr("*", "1 as id", "2 as v", "3 as block", "4 as dim", "5 as score", "6 as row", "7 as cluster")
    assert rows_of(mine(clash)) == want
    assert mine(spark.createDataFrame([], VECTORS)).collect() == []
    assert mine(df.filter("vec_id % 10 <> 0")).collect() == []


def test_bounds_hold_and_stop_walks():
    rng = np.random.default_rng(4)
    centre = rng.normal(size=8)
    members = np.rint(256 * (centre + 0.1 * rng.normal(size=(20, 8))))
    rows = np.rint(256 * rng.normal(size=(20_000, 8)))
    c = negatives.Clusters({8: negatives.fit_centres(negatives.directions(members), 2)})
    near, cosine = c.assign(members)
    c.widest = {8: np.array([cosine[near == j].min() for j in range(2)])}
    exact = members @ rows.T
    for j in range(2):
        bound = negatives.list_bounds(rows, c.of(8)[j], c.widest[8][j])
        inside = near == j
        assert (exact[inside] <= negatives.lengths_of(members[inside])[:, None] * bound + 1e-6).all()
    orders, bounds = c.lists(rows)
    labels, ids = np.zeros(20_000, np.int64), np.arange(100, 20_100)
    for j in range(2):
        w = negatives.Walkers(np.arange(20).tobytes(), labels[:20].tobytes(), negatives.packed(members), 8, 5)
        done = w.walk(ids, labels, rows.astype(np.int64), np.frombuffer(orders[j], "<u4"), np.frombuffer(bounds[j], "<f8"))
        for m in np.flatnonzero(near == j):
            assert sorted(s for s, _ in w.heaps[m, 0]) == sorted(exact[m])[-5:]
        assert done < exact.size * 0.7


def test_copies():
    ids = np.array([5, 5, 5, 1, 2, 3, 4, 9, 7], np.int64)
    kept = negatives.without_copies(ids, np.zeros(9, np.int64), np.ones((9, 2)), 2)
    assert sorted(ids[kept]) == [1, 2, 3]
    assert len(negatives.without_copies(ids, np.arange(9), np.ones((9, 2)), 2)) == 9
    twice = np.array([1, 1, 1, 2, 3], np.int64)
    assert sorted(twice[negatives.without_copies(twice, np.zeros(5, np.int64), np.ones((5, 2)), 2)]) == [1, 1, 2, 3]
