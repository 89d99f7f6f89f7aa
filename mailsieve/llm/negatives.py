"""Hard negatives by shared lists: candidates are sorted once for each cluster of anchors, and every member walks that list.

Components become whole numbers, floor(scale * x); a score is their inner product, in whole numbers. Anchors are
clustered by direction; a cluster knows the widest angle between its centre and a member. Rows are packed into chunks
where they lie, and each chunk keeps, for every cluster, its rows in the order of the angular upper bound
``|row| * cos(max(0, angle to the centre - widest angle))``: the bound holds for all members alike, so the list
is sorted once and read by all of them, in both walks. A member walks from the top in steps, computes the scores of
a step at once, and stops when its own length times the next bound is below the worst score that it could still use.

The first walk finds the positives, the highest rows of the anchor's label. The second finds, for each positive, the
highest rows of other labels with a score between ``share`` percent of the positive's and the positive's. Anchors meet
the chunks in an equi-join of blocks with groups of chunks; the lists of all groups meet in ranking windows.

Exact: the bounds carry more slack than their rounding, and scores are whole numbers below 2**63. Centres are fitted on
``sample`` anchors at most, which has no influence on the result, only on how far members walk. Of copies (equal
label and vector) a chunk keeps the rows of the smallest ids that any list could take, so a hot vector costs little.

Defined results: rows with a null id, a null label, a null vector or a null, NaN or infinite component take no part, nor
do rows whose squared length in whole numbers is 2**63 or more, as their scores are no 64-bit integers. Vectors meet those
of their own length only; an empty vector has the score 0. Rows with the anchor's id are no positives of it. Rows of
the same id count each; each anchor row gives its own result. Ties go to the smaller id. A positive with a negative score
has an empty range. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.session import materialize

_FOUND = (
    "block bigint, place int, slot int, anchor_id bigint, positive_id bigint, positive_score bigint, other_id bigint, score bigint"
)
_SLACK = 1e-6
_STEP = 512
_LEAST, _MOST = -(2**63), 2**63 - 1


def usable(vectors: DataFrame, id_column: str, vector_column: str, label_column: str, scale: int) -> DataFrame:
    """(id, label, v) of the rows that take part; ``v`` holds whole numbers as doubles."""
    rows = vectors.select(
        vectors[id_column].cast("bigint").alias("id"), vectors[label_column].cast("bigint").alias("label"),
        vectors[vector_column].cast("array<double>").alias("x"),
    )
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.filter("id is not null and label is not null and x is not null").filter(~F.exists("x", bad))

    def representable(row: np.ndarray) -> bool:
        return bool(np.isfinite(row).all()) and sum(int(x) ** 2 for x in row) <= _MOST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            with np.errstate(over="ignore"):
                whole = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                all_fit = (whole * whole).sum() < 2.0**62
            values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(whole, pa.float64()))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], ["id", "label", "v"])
            if not all_fit:  # only then is each row looked at by itself
                out = out.filter(pa.array([representable(whole[a:b]) for a, b in zip(ends, ends[1:])], pa.bool_()))
            yield out

    return rows.mapInArrow(run, "id bigint, label bigint, v array<double>")


# --- clusters ---------------------------------------------------------------


def lengths_of(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v.astype(np.float64) ** 2).sum(1))


def directions(v: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay zero."""
    return v.astype(np.float64) / np.maximum(lengths_of(v), 1e-300)[:, None]


def fit_centres(units: np.ndarray, clusters: int, steps: int = 8) -> np.ndarray:
    """Unit centres by repeated means; the first ones are spread over the rows as given."""
    centres = units[np.linspace(0, len(units) - 1, clusters).astype(int)].copy()
    for _ in range(steps):
        near = (units @ centres.T).argmax(1)
        for j in range(clusters):
            if (near == j).any():
                centres[j] = units[near == j].sum(0)
        centres = directions(centres)
    return centres


def list_bounds(v: np.ndarray, centre: np.ndarray, widest: float) -> np.ndarray:
    """For each row an upper bound of its score with any member, for a member of length 1; ``widest``: least cosine."""
    cosine = np.clip(directions(v) @ centre, -1.0, 1.0)
    turned = cosine * widest + np.sqrt(1 - cosine**2) * np.sqrt(1 - widest**2)
    return lengths_of(v) * (np.where(cosine >= widest, 1.0, turned) + _SLACK)


class Clusters:
    """Unit centres for each vector length, and the least cosine of a member to its centre."""

    def __init__(self, centres: dict[int, np.ndarray]):
        self.centres = centres
        self.widest = {dim: np.ones(len(c)) for dim, c in centres.items()}

    def of(self, dim: int) -> np.ndarray:
        return self.centres.get(dim, np.zeros((1, dim)))

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosine = directions(v) @ self.of(v.shape[1]).T
        near = cosine.argmax(1)
        return near, np.clip(cosine[np.arange(len(v)), near], -1.0, 1.0)

    def lists(self, v: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """The order of the rows for each cluster, and the bound at the beginning of each step."""
        orders, bounds = [], []
        for centre, widest in zip(self.of(v.shape[1]), self.widest.get(v.shape[1], [-1.0])):
            bound = list_bounds(v, centre, widest)
            order = np.argsort(-bound, kind="stable")
            orders.append(order.astype("<u4").tobytes())
            bounds.append(bound[order[::_STEP]].astype("<f8").tobytes())
        return orders, bounds


# --- chunks and blocks --------------------------------------------------------


def packed(v: np.ndarray) -> bytes:
    """Whole numbers in 16 bits where they fit, else in 64."""
    small = not v.size or np.abs(v).max() < 1 << 15
    return v.astype("<i2" if small else "<i8").tobytes()


def unpacked(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if len(data) == 2 * rows * dim else "<i8").reshape(rows, dim)


def without_copies(ids: np.ndarray, labels: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Rows to keep: of each label and vector those of the ``most + 1`` smallest ids, ``most`` rows of each id."""
    whole = np.ascontiguousarray(np.concatenate([labels[:, None], v.astype(np.int64)], axis=1))
    _, group = np.unique(whole, axis=0, return_inverse=True)
    group = group.ravel()
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    new_group = np.append(True, g[1:] != g[:-1])
    new_id = new_group | np.append(True, i[1:] != i[:-1])
    at = np.arange(len(g))
    since = lambda mark: at - np.maximum.accumulate(np.where(mark, at, 0))
    number = np.cumsum(new_id)
    id_rank = number - np.maximum.accumulate(np.where(new_group, number, 0))
    return np.sort(order[(since(new_id) < most) & (id_rank <= most)])


def chunks(rows: DataFrame, clusters: Clusters, size: int, most: int) -> DataFrame:
    """Rows packed into matrices of at most ``size`` rows, each with its sorted lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: dict[int, list] = {}

        def pack(dim):
            ids, labels, vs = zip(*open_rows.pop(dim))
            ids, labels, v = np.array(ids, np.int64), np.array(labels, np.int64), np.array(vs, np.float64).reshape(len(ids), dim)
            kept = without_copies(ids, labels, v, most)
            orders, bounds = clusters.lists(v[kept])
            values = [dim, ids[kept].tobytes(), labels[kept].tobytes(), packed(v[kept]), orders, bounds]
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)], ["dim", "ids", "labels", "vectors", "orders", "bounds"])

        for batch in batches:
            for i, label, v in zip(*(batch.column(c).to_pylist() for c in range(3))):
                held = open_rows.setdefault(len(v), [])
                held.append((i, label, v))
                if len(held) == size:
                    yield pack(len(v))
        for dim in sorted(open_rows):
            yield pack(dim)

    return rows.mapInArrow(run, "dim int, ids binary, labels binary, vectors binary, orders array<binary>, bounds array<binary>")


def assigned(anchors: DataFrame, clusters: Clusters) -> DataFrame:
    """(id, label, v, dim, cluster, cosine)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs = batch.column(2).to_pylist()
            near, cosine = np.zeros(len(vs), np.int32), np.zeros(len(vs))
            dims = np.array([len(v) for v in vs], np.int32)
            for dim in set(dims.tolist()):
                at = np.flatnonzero(dims == dim)
                near[at], cosine[at] = clusters.assign(np.array([vs[i] for i in at], np.float64).reshape(len(at), dim))
            columns = [*batch.columns, pa.array(dims), pa.array(near, pa.int32()), pa.array(cosine)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "v", "dim", "cluster", "cosine"])

    return anchors.mapInArrow(run, "id bigint, label bigint, v array<double>, dim int, cluster int, cosine double")


def blocks(members: DataFrame, sizes: dict[tuple[int, int], int], size: int) -> DataFrame:
    """Anchors of a cluster packed into matrices of about ``size`` rows; a large cluster gives many of them."""
    deals = [(d, c, -(-n // size)) for (d, c), n in sizes.items()]
    table = members.sparkSession.createDataFrame(deals, "dim int, cluster int, deals int")  # a row for each cluster
    dealt = members.join(table, ["dim", "cluster"]).withColumn("deal", F.pmod(F.xxhash64("row"), F.col("deals")))
    grouped = dealt.groupBy("dim", "cluster", "deal").agg(F.collect_list(F.struct("id", "label", "v")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, cluster, rows in zip(*(batch.column(c).to_pylist() for c in range(3))):
                rows.sort(key=lambda r: (r["id"], r["label"], r["v"]))
                v = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), dim)
                values = [dim, cluster, np.array([r["id"] for r in rows], np.int64).tobytes(), np.array([r["label"] for r in rows], np.int64).tobytes(), packed(v)]
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)], ["dim", "cluster", "a_ids", "a_labels", "a_vectors"])

    rows = grouped.select("dim", "cluster", "rows").mapInArrow(run, "dim int, cluster int, a_ids binary, a_labels binary, a_vectors binary")
    return rows.withColumn("block", F.monotonically_increasing_id())


# --- walks ------------------------------------------------------------------


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact below 2**63."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T  # sums wrap and come back


class Walkers:
    """Members of a block with what they have found: for each of their slots a range of scores and the best in it."""

    def __init__(self, ids: bytes, labels: bytes, vectors: bytes, dim: int, k: int, low=None, high=None):
        self.ids, self.labels, self.k = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), k
        self.v = unpacked(vectors, len(self.ids), dim)
        self.length = lengths_of(self.v)
        self.same = low is None
        self.need = np.full((len(self.ids), 1), _LEAST, np.int64) if self.same else low.copy()
        self.high = np.full((len(self.ids), 1), _MOST, np.int64) if self.same else high
        self.heaps: dict[tuple[int, int], list] = {}

    def walk(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, order: np.ndarray, bounds: np.ndarray) -> int:
        """Go down one list; the number of scores computed."""
        done = 0
        open_slot = self.need <= self.high
        for step, bound in enumerate(bounds.tolist()):
            wanted = np.where(open_slot, self.need.astype(np.float64), np.inf).min(1)
            going = np.flatnonzero(self.length * bound + _SLACK >= wanted)
            if not len(going):
                break
            rows = order[step * _STEP : (step + 1) * _STEP]
            score = products(self.v[going], v[rows])
            done += score.size
            partner = (self.labels[going][:, None] == labels[rows]) == self.same
            if self.same:
                partner &= self.ids[going][:, None] != ids[rows]
            for slot in range(self.need.shape[1]):
                need, high = self.need[going, slot], self.high[going, slot]
                member, row = np.nonzero(partner & (score >= need[:, None]) & (score <= high[:, None]) & open_slot[going, slot][:, None])
                for m, r, s in zip(going[member].tolist(), rows[row].tolist(), score[member, row].tolist()):
                    # The smallest of a heap is its worst: lowest score, then largest id.
                    heap, entry = self.heaps.setdefault((m, slot), []), (s, -int(ids[r]))
                    if len(heap) < self.k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == self.k:
                        self.need[m, slot] = max(self.need[m, slot], heap[0][0])
        return done


def _walked(blocks_: DataFrame, groups: DataFrame, n_groups: int, k: int, ranges: bool) -> DataFrame:
    """What the members of all blocks find in the lists of all groups of chunks."""
    left = blocks_.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    order, bound = F.get("orders", F.col("cluster")), F.get("bounds", F.col("cluster"))
    positives = F.col("positives") if ranges else F.lit(None).cast("array<struct<place:int,slot:int,score:bigint,other_id:bigint>>")
    pairs = left.join(groups, ["dim", "part"]).select(
        "block", "dim", "a_ids", "a_labels", "a_vectors", "ids", "labels", "vectors", order.alias("order"), bound.alias("bound"), positives.alias("positives")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Walkers, dict]] = {}

        def emit(block):
            walkers, known = held.pop(block)
            out = []
            for (m, slot), heap in walkers.heaps.items():
                score, other = known.get((m, slot), (None, None))
                out += [(block, m, slot, int(walkers.ids[m]), other, score, -i, s) for s, i in heap]
            names = [f.split()[0] for f in _FOUND.split(", ")]
            kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 8, kinds)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i].as_py() for c in range(11)]
                block, dim = row[0], row[1]
                if block not in held:
                    if len(held) == 16:  # so many blocks keep their lists in a task
                        yield emit(next(iter(held)))
                    known, low, high = {}, None, None
                    if ranges:
                        n = len(row[2]) // 8
                        slots = 1 + max((p["slot"] for p in row[10]), default=0)
                        low, high = np.full((n, slots), _MOST, np.int64), np.full((n, slots), _LEAST, np.int64)
                        for p in row[10]:
                            known[p["place"], p["slot"]] = (p["score"], p["other_id"])
                            high[p["place"], p["slot"]] = p["score"]
                            low[p["place"], p["slot"]] = p["low"]
                    held[block] = (Walkers(row[2], row[3], row[4], dim, k, low, high), known)
                ids = np.frombuffer(row[5], "<i8")
                v = unpacked(row[7], len(ids), dim)
                held[block][0].walk(ids, np.frombuffer(row[6], "<i8"), v, np.frombuffer(row[8], "<u4"), np.frombuffer(row[9], "<f8"))
        for block in list(held):
            yield emit(block)

    best = Window.partitionBy("block", "place", "slot").orderBy(F.desc("score"), "other_id")
    return pairs.mapInArrow(run, _FOUND).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, id_column: str, vector_column: str, label_column: str, positives: int = 5, negatives: int = 5,
    share: int = 80, scale: int = 256, sample: int = 8192, block_rows: int = 256, chunk_rows: int = 2048, group_chunks: int = 8,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor`` is a condition on ``id``."""
    good = usable(vectors, id_column, vector_column, label_column, scale)
    anchors = materialize(good.filter(is_anchor).withColumn("row", F.monotonically_increasing_id()), "anchors")
    # Centres come from a bounded sample, a cluster for 64 anchors, 64 clusters at most.
    few = anchors.orderBy(F.xxhash64("id", "v"), "id", "row").select("v").limit(sample).collect()
    by_dim: dict[int, list] = {}
    for (v,) in few:
        by_dim.setdefault(len(v), []).append(v)
    clusters = Clusters({
        dim: fit_centres(directions(np.array(vs).reshape(len(vs), dim)), min(64, -(-len(vs) // 64))) for dim, vs in by_dim.items()
    })
    members = materialize(assigned(anchors.select("id", "label", "v"), clusters).withColumn("row", F.monotonically_increasing_id()), "members")
    sizes = {}
    for dim, cluster, n, least in members.groupBy("dim", "cluster").agg(F.count(F.lit(1)), F.min("cosine")).collect():
        sizes[dim, cluster] = n
        clusters.widest.setdefault(dim, np.ones(len(clusters.of(dim))))[cluster] = max(-1.0, least - 1e-12)
    lists = materialize(
        chunks(good, clusters, chunk_rows, max(positives, negatives)).withColumn("chunk", F.monotonically_increasing_id()), "lists"
    )
    n_groups = max(1, -(-lists.count() // group_chunks))
    groups = lists.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(n_groups)).cast("int")).drop("chunk")
    packed_anchors = materialize(blocks(members, sizes, block_rows), "blocks")
    low = F.expr(f"cast(ceil(cast(score as decimal(20,0)) * {share} / 100) as bigint)")
    found = _walked(packed_anchors, groups, n_groups, positives, False).withColumns({"slot": F.col("rank") - 1, "low": low})
    # A block has about as many rows as it has members, times the positives.
    ranges = found.groupBy("block").agg(F.collect_list(F.struct("place", "slot", "score", "other_id", "low")).alias("positives"))
    with_ranges = materialize(packed_anchors.join(ranges, "block"), "ranges")
    return _walked(with_ranges, groups, n_groups, negatives, True).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
