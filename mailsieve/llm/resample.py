"""Importance resampling towards a target: hashed word runs, gains of buckets, the highest noisy weights are drawn.

The features of a text are its runs of one to three words. A block of words is one byte stream, in which every run is a
stretch. Distinct runs of equal length become a matrix of bytes; the checksums of all its rows advance one column
at a time, and their buckets are scattered back to the places of the runs. The buckets of every text are written
once, two bytes for a run, so that counts and weights need no text again.

Counts cover all rows of both tables. The draw sorts nothing but the rows near its cut: a quantile summary gives a
score with certainly enough rows above it; these are dealt by ranges and numbered, and the row of the last rank
divides the drawn from the others.

Defined results: a null or empty text has no features and weight 0; texts of fewer than ``min_words`` words are never
drawn; ties go to the smaller id, null ids last; rows of the same id are drawn one by one; the noise of a null id is that
of an empty one; other columns are ignored; an empty table gives no rows, an empty target counts nothing. Runs of more
than ``LONG_RUN`` bytes are summed by the library's function, long texts in blocks of bounded size.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.tokens import arrow_rows
from mailsieve.session import materialize

RUN = 3
LONG_RUN = 4096
#: Words, and bytes of one text, that are worked on at once.
BLOCK_WORDS, BLOCK_BYTES = 1 << 17, 1 << 22
_ID_BITS = 21  # three word numbers fit into one key
_MATRIX = 1 << 22

#: Capitals fall to small letters, all that stands between words becomes a blank.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32_rows(columns: np.ndarray) -> np.ndarray:
    """Checksums of byte rows of equal length, given as a matrix of (length, rows)."""
    crc = np.full(columns.shape[1], 0xFFFFFFFF, np.uint32)
    for column in columns:
        crc = _CRC[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
    return ~crc


def stretch_crcs(stream: bytes, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of stretches of a stream, one matrix for each length."""
    data, out = np.frombuffer(stream, np.uint8), np.zeros(len(begin), np.uint32)
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    for size, a, b in zip(sizes.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        if size > LONG_RUN:
            for i in order[a:b].tolist():
                out[i] = zlib.crc32(stream[begin[i] : begin[i] + size])
            continue
        step = max(1, _MATRIX // size)
        for at in range(a, b, step):
            rows = order[at : min(b, at + step)]
            out[rows] = crc32_rows(data[begin[rows] + np.arange(size)[:, None]])
    return out


def word_parts(text: str) -> Iterator[tuple[list[bytes], int]]:
    """Words of a text in parts of bounded size, each after the last words of the one before, and how many these are."""
    data, at, before = text.encode("utf-8", "surrogatepass").translate(_FOLD), 0, []
    while at < len(data) or not at:
        cut = data.find(b" ", at + BLOCK_BYTES) if len(data) - at > 2 * BLOCK_BYTES else -1
        end = cut if cut >= 0 else len(data)
        words = before + (data if not at and end == len(data) else data[at:end]).split()
        yield words, len(before)
        before, at = words[1 - RUN :], max(end, 1)


def run_buckets(parts: list[tuple[list[bytes], int]], buckets: int) -> list[np.ndarray]:
    """Buckets of the runs that end at the words of each part, its leading words left out."""
    words = list(itertools.chain.from_iterable(p for p, _ in parts))
    sizes = np.array([len(p) for p, _ in parts], np.int64)
    if not words:
        return [np.zeros(0, np.uint16)] * len(parts)
    stream = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(lengths + 1) - 1
    begin = end - lengths
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) >> _ID_BITS:
        raise ValueError("too many words in a block")
    part = np.repeat(np.arange(len(parts)), sizes)
    inside = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = inside >= np.repeat(np.array([n for _, n in parts]), sizes)
    found = np.full((len(words), RUN), -1, np.int32)
    keys, places = ids, []
    distinct_begin, distinct_end, inverse = [], [], []
    for n in range(1, RUN + 1):
        if n > 1:  # the run that ends at a word: the key of the shorter one before it, then the word
            keys = np.concatenate([[0], keys[:-1]]) << _ID_BITS | ids
        last = np.flatnonzero(own & (inside >= n - 1))
        _, first, back = np.unique(keys[last], return_index=True, return_inverse=True)
        places.append(last)
        distinct_begin.append(begin[last[first] - (n - 1)])
        distinct_end.append(end[last[first]])
        inverse.append(back)
    starts = np.concatenate(distinct_begin)
    bucket = (stretch_crcs(stream, starts, np.concatenate(distinct_end) - starts) % np.uint32(buckets)).astype(np.int32)
    offset = 0
    for n in range(RUN):
        found[places[n], n] = bucket[offset + inverse[n]]
        offset += len(distinct_begin[n])
    kept = found >= 0
    counts = np.bincount(part, kept.sum(1), len(parts)).astype(np.int64)
    return np.split(found[kept].astype(np.uint16), np.cumsum(counts)[:-1])


def text_buckets(texts: list[str], buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """Number of words of each text, and the buckets of its runs as little-endian unsigned 16-bit integers."""
    n_words, out = np.zeros(len(texts), np.int64), [b""] * len(texts)
    held, owner, size = [], [], 0

    def collect():
        for i, values in zip(owner, run_buckets(held, buckets)):
            data = values.astype("<u2").tobytes()
            out[i] = out[i] + data if out[i] else data

    for i, text in enumerate(texts):
        for words, lead in word_parts(text):
            for at in range(lead, max(len(words), lead + 1), BLOCK_WORDS):
                run = words[max(0, at - (RUN - 1)) : at + BLOCK_WORDS]
                before = min(at, RUN - 1)
                held.append((run, before))
                owner.append(i)
                n_words[i] += len(run) - before
                size += len(run)
                if size >= BLOCK_WORDS:
                    collect()
                    held, owner, size = [], [], 0
    if held:
        collect()
    return n_words, out


def features(docs: DataFrame, buckets: int, id_column: str, text_column: str) -> DataFrame:
    """(id, n_words, n_features, buckets) of every row."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("between 1 and 65536 buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in arrow_rows(batches):
            n_words, found = text_buckets(texts, buckets)
            columns = [
                rows.column(0), pa.array(n_words, pa.int64()), pa.array([len(b) // 2 for b in found], pa.int64()), pa.array(found, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_features", "buckets"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(docs[id_column], docs[text_column]).mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, buckets binary")


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 16-bit values of a binary column and their number in each row."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), "<u2"), np.fromiter((len(b) // 2 for b in data), np.int64, len(data))


def bucket_counts(featured: DataFrame, buckets: int) -> list[int]:
    """Features of all rows in each bucket. A task adds up its rows; only ``buckets`` sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_values(batch.column(0))[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    sums = featured.select("buckets").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for bucket, n in sums.collect():
        out[bucket] = n
    return out


def bucket_gains(source: list[int], target: list[int]) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of target and source, rounded down."""
    size, all_source, all_target = len(source), float(sum(source)), float(sum(target))
    return np.array(
        [
            math.floor(1000 * math.log((float(t) + 1) * (all_source + size) / ((float(s) + 1) * (all_target + size))))
            for s, t in zip(source, target)
        ],
        np.int64,
    )


def with_weight(featured: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): the sum of the gains of a row's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = _values(batch.column(3))
            upto = np.concatenate([[0], np.cumsum(gains[values])])
            ends = np.cumsum(sizes)
            weight = upto[ends] - upto[ends - sizes]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], ["id", "n_words", "n_features", "weight"])

    kind = featured.schema["id"].dataType.simpleString()
    return featured.select("id", "n_words", "n_features", "buckets").mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(id_column: Column, seed: int) -> Column:
    """Repeatable noise in thousandths, from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


_ACCURACY = 10_000


def with_rank(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """Add ``rank`` to a written table: 1, 2, ... for the highest ``percent`` of the eligible rows, else null.

    Rows come in the order of score, id and ``row``, a number that tells them apart.
    """
    n = scored.filter(eligible).count()
    k = percent * n // 100
    none = scored.withColumn("rank", F.lit(None).cast("bigint"))
    if not k:
        return none
    order = [-F.col("score"), F.col("id").isNull(), F.col("id"), F.col("row")]
    keyed = scored.filter(eligible).withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    # The summary errs by a 10,000th of the rows at most, so enough rows have at least this score.
    share = max(0.0, 1 - k / n - 2 / _ACCURACY)
    least = scored.filter(eligible).agg(F.percentile_approx("score", share, _ACCURACY)).first()[0]
    for near in (keyed.filter(F.col("score") >= least), keyed):
        ranged = near.repartitionByRange("_key").sortWithinPartitions("_key")
        placed = materialize(ranged.withColumn("_m", F.monotonically_increasing_id()), "ranked")
        task, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
        counts = sorted(placed.groupBy(task.alias("t")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each task
        if sum(c for _, c in counts) >= k:
            break
    before = list(itertools.accumulate((c for _, c in counts), initial=0))
    offsets = scored.sparkSession.createDataFrame([(t, b) for (t, _), b in zip(counts, before)], "_t bigint, _before bigint")
    numbered = placed.join(F.broadcast(offsets), task == F.col("_t")).withColumn("rank", (F.col("_before") + place + 1).cast("bigint"))
    last = numbered.filter(F.col("rank") == k).select("score", "id", "row").first()
    cut = F.struct(
        F.lit(-last["score"]).cast("bigint").alias("k0"), F.lit(last["id"] is None).alias("k1"),
        F.lit(last["id"]).cast(scored.schema["id"].dataType).alias("k2"), F.lit(last["row"]).cast("bigint").alias("k3"),
    )
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    others = none.filter(~F.coalesce(eligible, F.lit(False)) | (key > cut))
    return numbered.filter(F.col("rank") <= k).select(*none.columns).unionByName(others)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, min_words: int = 20, buckets: int = 10_000,
    id_column: str = "doc_id", text_column: str = "text", target_column: str = "text",
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``; ``rank`` is null where it is not drawn."""
    featured = materialize(features(docs, buckets, id_column, text_column), "run-buckets")
    wanted = features(target.select(F.lit(0).alias("id"), target[target_column].alias("text")), buckets, "id", "text")
    gains = bucket_gains(bucket_counts(featured, buckets), bucket_counts(wanted, buckets))
    score = (F.col("weight") + gumbel(F.col("id"), seed)).cast("bigint")
    weighted = with_weight(featured, gains).withColumns({"score": score, "row": F.monotonically_increasing_id()})
    ranked = with_rank(materialize(weighted, "scored"), F.col("n_words") >= min_words, percent)
    return ranked.select(F.col("id").alias(id_column), "n_features", "weight", "score", "rank")
