"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. One pass over the texts gives each document the number of its distinct shingles, a digest of its word sequence, the
   hashes of ``bands`` groups of ``band_rows`` minima, and the low ``BITS`` bits of all minima as packed bit planes.
2. Documents with the same digest are one class; only its smallest id goes on, so copies are never paired.
3. Band hashes that two classes or more share are buckets. Every member is first compared with the leader of its
   bucket, the class with the most copies.
4. What is then still in different components of one bucket is compared by signature, in tiles of bounded size. The
   share of equal low bits, corrected for chance collisions, estimates the similarity; rows with a partner whose
   estimate is above the threshold less a slack of several deviations get their full sets, and the tile confirms its
   likely pairs, best first, until no two of its components have one left that is not confirmed or refuted. A pair
   is looked at in the first band that it shares only. A tile passes on links that join components, fewer than rows.

A link needs ``100 * intersection >= 100 * threshold * union`` on the full sets of 64-bit shingle hashes. A pair with
just the threshold similarity of 0.75 shares none of 32 bands of 4 minima with a probability of 5e-6.

Defined results: documents without words have no shingles, link with nothing and stay; those with fewer words than a
shingle have one, their whole sequence. Null ids link with nothing and stay, their component is null. An id is
one document: where rows share an id, links are looked for with the text of the smallest digest, and they stay or go
together; ``one_of_each`` keeps one row of an id. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.tokens import arrow_rows
from mailsieve.session import materialize

BITS = 4
_P = np.uint64(0x9E3779B97F4A7C15)
_SIGNED = "id bigint, n_shingles bigint, key_high bigint, key_low bigint, bands array<bigint>, planes binary, marks binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct 64-bit hashes of the word shingles of a text; word hashes are kept in a bounded table."""

    def __init__(self, size: int = 5, max_words: int = 150_000):
        import xxhash

        class Words(dict):
            def __missing__(self, word):
                self[word] = value = xxhash.xxh3_64_intdigest(word)
                return value

        self.size, self.max_words, self.words, self.digest = size, max_words, Words(), xxhash.xxh3_128_digest

    def split(self, text: str) -> list[bytes]:
        """Words between ASCII white space, A-Z lower-cased."""
        return text.encode("utf-8", "surrogatepass").lower().split()

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.empty(0, np.uint64)
        if len(self.words) > self.max_words:
            self.words.clear()
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        if len(w) < self.size:
            w = np.append(w, np.uint64(len(w)))  # no shingle of full size can be taken for it
            joined, width = w[:1].copy(), len(w)
        else:
            joined, width = w[: len(w) - self.size + 1].copy(), self.size
        for j in range(1, width):
            joined = _mix(joined * _P + w[j : j + len(joined)])
        return np.unique(joined)


class Signer:
    """Band hashes and packed low bits of the minima of a set."""

    def __init__(self, bands: int = 32, band_rows: int = 4, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.band_rows, self.n = bands, band_rows, bands * band_rows
        self.flip = rng.integers(0, 1 << 32, self.n, np.uint32)[:, None]
        self.odd = (rng.integers(0, 1 << 32, self.n, np.uint32) | np.uint32(1))[:, None]
        self.salt = _mix(np.arange(1, bands + 1, dtype=np.uint64) * _P)
        self.work = np.empty((self.n, 1024), np.uint32)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        best = np.full(self.n, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 1024):
            part = low[at : at + 1024]
            work = self.work[:, : len(part)]
            np.bitwise_xor(part, self.flip, out=work)
            np.multiply(work, self.odd, out=work)
            np.minimum(best, work.min(1), out=best)
        return best

    def band_hashes(self, minima: np.ndarray) -> np.ndarray:
        rows = minima.reshape(self.bands, self.band_rows).astype(np.uint64)
        out = self.salt.copy()
        for j in range(self.band_rows):
            out = _mix(out * _P + rows[:, j])
        return out

    def planes(self, minima: np.ndarray) -> bytes:
        """Bit plane by bit plane, the low bits of all minima."""
        return b"".join(np.packbits((minima >> b & 1).astype(np.uint8)).tobytes() for b in range(BITS))


def similarity(matches: np.ndarray, n: int) -> np.ndarray:
    """Estimate from the number of equal low-bit groups, without what chance makes equal."""
    chance = 1 / (1 << BITS)
    return (matches / n - chance) / (1 - chance)


def equal_groups(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For all rows of ``a`` and ``b`` (planes as rows of words, BITS equal parts) the number of equal minima groups."""
    words = a.shape[1] // BITS
    differ = np.zeros((len(a), len(b), words), a.dtype)
    for plane in range(BITS):
        part = slice(plane * words, (plane + 1) * words)
        differ |= a[:, None, part] ^ b[None, :, part]
    return n - np.bitwise_count(differ).sum(2, dtype=np.int32)


def sign(docs: DataFrame, id_column: str, text_column: str, size: int, bands: int, band_rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(size), Signer(bands, band_rows)
        for part, texts in arrow_rows(batches):
            counts, high, low, hashes, planes, marks = [], [], [], [], [], []
            for text in texts:
                words = shingler.split(text)
                found = shingler.hashes(words)
                counts.append(len(found))
                key = np.frombuffer(shingler.digest(b" ".join(words)), "<i8")
                high.append(key[0])
                low.append(key[1])
                minima = signer.minima(found)
                hashes.append(signer.band_hashes(minima).view(np.int64))
                marks.append(hashes[-1].astype(np.uint32).tobytes())  # half of each band hash
                planes.append(signer.planes(minima))
            ends = pa.array(np.arange(len(texts) + 1) * bands, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(counts, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate(hashes))), pa.array(planes, pa.binary()),
                    pa.array(marks, pa.binary()),
                ],
                ["id", "n_shingles", "key_high", "key_low", "bands", "planes", "marks"],
            )

    return docs.select(docs[id_column].cast("bigint"), docs[text_column]).mapInArrow(run, _SIGNED)


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """(id, text) to (id, digest of the words, sorted shingle hashes as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for part, found in arrow_rows(batches):
            split = [shingler.split(t) for t in found]
            keys = [np.frombuffer(shingler.digest(b" ".join(w)), "<i8") for w in split]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                    pa.array([shingler.hashes(w).tobytes() for w in split], pa.binary()),
                ],
                ["id", "key_high", "key_low", "hashes"],
            )

    return texts.mapInArrow(run, "id bigint, key_high bigint, key_low bigint, hashes binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are as similar as asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(left.as_py(), np.uint64), np.frombuffer(right.as_py(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("right"))
    # Sets of any length travel with their pairs: few rows at a time go to the workers.
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def _same(a: DataFrame, b: DataFrame) -> bool:
    sums = [df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first() for df in (a, b)]
    return sums[0] == sums[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the smallest node that it reaches.

    Large-star and small-star steps in turn, each an aggregation and a join, until the edges stay as they are.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialize(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if _same(now, small):
            break
        now = small
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _merge(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Components after new edges; only the edges between the old components take part in the search."""
    if labels is None:
        labels = components(edges)
    else:
        of = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_old"))
        lifted = (
            edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
            .select(F.coalesce("a_old", "a").alias("a"), F.coalesce("b_old", "b").alias("b")).filter("a != b").distinct()
        )
        fresh = materialize(components(lifted), "components")
        moved = fresh.select(F.col("node").alias("component"), F.col("component").alias("new"))
        old = labels.join(moved, "component", "left").select("node", F.coalesce("new", "component").alias("component"))
        labels = old.unionAll(fresh.join(labels, "node", "left_anti").select("node", "component"))
    return materialize(labels, "components")


def _likely(rows: dict[str, np.ndarray], bucket_band: np.ndarray, n: int, threshold: float, slack: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row by row, the others of a tile that may be similar to it, with their estimates.

    Only pairs of different components, of fitting sizes, and whose first common band is this bucket's.
    """
    percent = round(100 * threshold)
    x, y = np.flatnonzero(rows["tile"] == rows["i"]), np.flatnonzero(rows["tile"] == rows["j"])
    own = rows["i"][0] == rows["j"][0]
    planes, sizes, component, bands = (rows[c] for c in ("planes", "n_shingles", "component", "marks"))
    for at in range(0, len(x), 256):
        part = x[at : at + 256]
        estimate = similarity(equal_groups(planes[part], planes[y], n), n)
        small = np.minimum(sizes[part][:, None], sizes[y][None])
        large = np.maximum(sizes[part][:, None], sizes[y][None])
        likely = (estimate >= threshold - slack) & (component[part][:, None] != component[y][None]) & (100 * small >= percent * large)
        if own:
            likely &= part[:, None] < y[None]
        for row in np.flatnonzero(likely.any(1)):
            others = np.flatnonzero(likely[row])
            same = bands[part[row]][None] == bands[y[others]]
            others = others[same.argmax(1) == bucket_band]
            if len(others):
                yield part[row], y[others], estimate[row, others]


def _tiles(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, dict[str, np.ndarray], pa.Table]]:
    """The tiles (bucket, i, j) of sorted batches, whole: bucket, columns as arrays and the rows themselves."""
    rest = None
    for batch in _with_end(batches):
        table = batch if rest is None else (rest if batch is None else pa.concat_tables([rest, batch]))
        if table is None or not table.num_rows:
            continue
        keys = [table.column(k).to_numpy() for k in ("bucket", "i", "j")]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        cuts = [0, *new.tolist(), *([table.num_rows] if batch is None else [])]
        rows = {c: table.column(c).to_numpy() for c in columns}
        for name, kind in (("planes", np.uint64), ("marks", np.uint32)):
            rows[name] = np.frombuffer(b"".join(table.column(name).to_pylist()), kind).reshape(table.num_rows, -1)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                yield keys[0][a], {c: v[a:b] for c, v in rows.items()}, table.slice(a, b - a)
        rest = table.slice(cuts[-1])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table | None]:
    for batch in batches:
        if batch.num_rows:
            yield pa.Table.from_batches([batch])
    yield None


_TILE = ("band", "i", "j", "tile", "id", "component", "n_shingles")


def _by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")


def rows_to_compare(tiles: DataFrame, n: int, threshold: float, slack: float) -> DataFrame:
    """The rows of each tile that have a likely partner there; never more than the tile has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, table in _tiles(batches, _TILE):
            wanted = np.zeros(table.num_rows, bool)
            for row, others, _ in _likely(rows, rows["band"][0], n, threshold, slack):
                wanted[row] = True
                wanted[others] = True
            if wanted.any():
                yield from table.filter(pa.array(wanted)).combine_chunks().to_batches()

    ordered = _by_tile(tiles.select("bucket", "band", "i", "j", "tile", "id", "component", "n_shingles", "planes", "marks"))
    return ordered.mapInArrow(run, ordered.schema)


def links_in_tiles(tiles: DataFrame, n: int, threshold: float, slack: float) -> DataFrame:
    """Confirmed links (a, b) between components of each tile, as many as join what can be joined.

    Every likely pair is confirmed on its full sets, best estimates first, unless links found before in the tile have
    joined its two components.
    """
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, table in _tiles(batches, _TILE):
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
            top: dict[int, int] = {}

            def root(x):
                while (up := top.get(x, x)) != x:
                    top[x] = x = top.get(up, up)
                return x

            a, b = [], []
            for row, others, estimate in _likely(rows, rows["band"][0], n, threshold, slack):
                mine = sets[row]
                for other in others[np.argsort(-estimate, kind="stable")]:
                    one, two = root(rows["component"][row]), root(rows["component"][other])
                    if one == two:
                        continue
                    theirs = sets[other]
                    at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                    common = int(np.count_nonzero(mine[at] == theirs))
                    if 100 * common >= percent * (len(mine) + len(theirs) - common):
                        top[max(one, two)] = min(one, two)
                        a.append(min(rows["id"][row], rows["id"][other]))
                        b.append(max(rows["id"][row], rows["id"][other]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _by_tile(tiles).mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.75, size: int = 5,
    bands: int = 32, band_rows: int = 4, slack: float = 0.19, tile_rows: int = 512,
) -> DataFrame:
    """One row per document: the size of its set, its component and whether it is the one that stays."""
    n, percent = bands * band_rows, round(100 * threshold)
    signed = materialize(sign(docs, id_column, text_column, size, bands, band_rows), "signed")
    linked = signed.filter("n_shingles > 0 and id is not null")
    classes = materialize(
        linked.groupBy("key_high", "key_low").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "classes"
    )
    one = F.min(F.struct("key_high", "key_low", "copies")).alias("one")  # an id with several texts: the smallest digest
    nodes = classes.groupBy("id").agg(one).select("id", "one.*")
    ones = linked.join(nodes, ["key_high", "key_low", "id"]).select("id", "n_shingles", "copies", F.posexplode("bands").alias("band", "bucket"))
    ones = ones.distinct()  # rows with the same id and text
    leaders = ones.groupBy("bucket").agg(
        F.min(F.struct((-F.col("copies")).alias("copies"), "id", "n_shingles")).alias("leader"), F.count("*").alias("members")
    ).filter("members > 1")
    leaders = materialize(leaders.select("bucket", "members", F.col("leader.id").alias("leader"), F.col("leader.n_shingles").alias("size")), "leaders")
    members = materialize(ones.join(leaders, "bucket").select("bucket", "band", "members", "id", "n_shingles", "leader", "size"), "members")

    involved = materialize(members.select("id").distinct().join(nodes, "id").drop("copies"), "involved")
    texts = docs.select(docs[id_column].cast("bigint").alias("id"), docs[text_column].alias("text"))
    node = ["id", "key_high", "key_low"]
    # The same join at every size: texts are dealt by id.
    sets = shingle_sets(texts.join(involved.select("id").hint("merge"), "id"), size).join(involved, node)
    sets = materialize(sets.dropDuplicates(["id"]).select("id", "hashes"), "sets")
    planes = linked.join(involved, node).dropDuplicates(["id"])
    planes = materialize(planes.select("id", "planes", "marks"), "planes")

    near = "100 * least(n_shingles, size) >= {0} * greatest(n_shingles, size)".format(percent)
    star = members.filter("id != leader").filter(near).select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    labels = _merge(None, materialize(confirm(materialize(star, "pairs"), sets, percent), "links"))

    known = members.select("bucket", "band", "members", "id", "n_shingles").join(labels.withColumnRenamed("node", "id"), "id", "left")
    known = materialize(known.withColumn("component", F.coalesce("component", "id")), "known")
    mixed = known.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
    mixed = materialize(mixed.select("bucket"), "mixed")
    tiles = (
        known.join(mixed, "bucket").join(planes, "id").withColumn("blocks", F.ceil(F.col("members") / tile_rows).cast("int"))
        .withColumn("tile", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))
    )
    wanted = materialize(rows_to_compare(tiles, n, threshold, slack), "wanted")
    links = materialize(links_in_tiles(wanted.join(sets, "id"), n, threshold, slack), "links")
    labels = _merge(labels, links)

    owner = classes.select("key_high", "key_low", "id").join(labels.withColumnRenamed("node", "id"), "id", "left")
    owner = materialize(owner.select("key_high", "key_low", F.coalesce("component", "id").alias("component_id")), "owners")
    own = signed.select("id", "n_shingles", "key_high", "key_low")
    found = own.join(owner, ["key_high", "key_low"], "left").withColumn(
        "component_id", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    )
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return found.select(F.col("id").alias(id_column), "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, and all without an id."""
    kept = near_duplicates(docs, id_column, text_column, **options).filter("kept").select(id_column).distinct()
    named = docs.filter(docs[id_column].isNotNull()).join(kept, id_column, "left_semi")
    # Of rows with one id the same stays in every run: that of the smallest digest of its text.
    whole = F.struct(*(F.col(c) for c in docs.columns))
    one = named.groupBy(F.col(id_column).alias("_id")).agg(F.min_by(whole, F.xxhash64(text_column)).alias("_row")).select("_row.*")
    return one.unionByName(docs.filter(docs[id_column].isNull()))
