"""Token ids as length-delimited binary records with a separate offset index.

A record file is a run of frames in ascending id order:

    length   u64   bytes of the payload
    check    u32   masked checksum of the length field
    payload        u8 width of an id (2 or 4), u8 1 if the row id is present, i64 row id, then the ids
    check    u32   masked checksum of the payload
    end      u8    0x0A

All numbers are little-endian; the mask is ``rotate_right(crc32, 15) + 0xA282EAD8``. Files are written by Spark's own
sink (a text row is a frame without its end mark, which the sink adds), so a lost task leaves no half file behind and
any file system that Spark knows will do. The index is a table of file, offset, length and token counts per record.

Defined results: a null or empty text is a record with the end id only; null ids come first; rows with the same id
stand next to each other, by the hash of their text; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailsieve.llm.tokens import arrow_rows, library_encoder
from mailsieve.session import scratch_path

_HEAD, _PREFIX = struct.Struct("<QI"), struct.Struct("<BBq")
_INDEX = "file string, id bigint, offset bigint, length bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def masked_checksum(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(row_id: int | None, ids: np.ndarray, width: int) -> bytes:
    """A frame without its end mark."""
    payload = _PREFIX.pack(width, row_id is not None, row_id or 0) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked_checksum(length)) + payload + struct.pack("<I", masked_checksum(payload))


def parse_frame(content: bytes, offset: int) -> tuple[int, int | None, np.ndarray]:
    """Offset of the next frame, row id and ids of the frame at ``offset``; raises on damage."""
    length, check = _HEAD.unpack_from(content, offset)
    end = offset + _HEAD.size + length
    if masked_checksum(content[offset : offset + 8]) != check or end + 5 > len(content):
        raise ValueError(f"damaged record length at byte {offset}")
    payload = content[offset + _HEAD.size : end]
    if masked_checksum(payload) != struct.unpack_from("<I", content, end)[0] or content[end + 4] != 10:
        raise ValueError(f"damaged record at byte {offset}")
    width, present, row_id = _PREFIX.unpack_from(payload)
    return end + 5, row_id if present else None, np.frombuffer(payload, f"<u{width}", offset=_PREFIX.size)


def write_records(
    docs: DataFrame, folder: str, path: str, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text",
    file_chars: int = 8 << 20,
) -> None:
    """Encode every text with the tokenizers library, append ``end_id`` and write records in ascending id order.

    The rows are dealt in id ranges, as many as give about ``file_chars`` characters for each file.
    """
    rows = docs.select(docs[id_column].cast("bigint").alias("id"), docs[text_column].alias("text"))
    chars = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    tie = F.xxhash64("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        width = 2 if max(encoder.vocabulary, end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        for part, texts in arrow_rows(batches):
            frames = [
                frame(i, np.frombuffer(b + end, "<u4"), width)
                for i, b in zip(part.column(0).to_pylist(), encoder.buffers(texts))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    (
        rows.repartitionByRange(max(1, math.ceil(chars / file_chars)), "id", tie)
        .sortWithinPartitions("id", tie)
        .mapInArrow(run, "frame binary")
        .select(F.col("frame").cast("string").alias("value"))
        .write.option("compression", "none")
        .text(f"{folder}/records")
    )


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").load(f"{folder}/records")
        .select(F.substring_index("path", "/", -1).alias("file"), "content")
    )


def write_index(spark: SparkSession, folder: str) -> None:
    """Read the record files, check every frame and write the offset index beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                content, offset, start, rows = content.as_py(), 0, 0, []
                while offset < len(content):
                    after, row_id, ids = parse_frame(content, offset)
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    rows.append((name.as_py(), row_id, offset, after - offset, start, len(ids), crc))
                    offset, start = after, start + len(ids)
                kinds = [pa.string()] + [pa.int64()] * 6
                arrays = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays(arrays, ["file", "id", "offset", "length", "start", "n_tokens", "ids_crc32"])

    _files(spark, folder).mapInArrow(run, _INDEX).write.parquet(f"{folder}/index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index with ``start`` counted over all files: a row's ids before it in the whole set.

    Only one sum for each file is brought together; the number in a file's name is its place in the order.
    """
    index = spark.read.schema(_INDEX).parquet(f"{folder}/index")
    place = F.regexp_extract("file", r"^part-(\d+)", 1).cast("bigint")
    sums = index.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"))
    before = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("file", F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("base"))
    return index.join(bases, "file").withColumn("start", F.col("base") + F.col("start")).drop("base")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records with their ids, in file order within each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                content, offset = content.as_py(), 0
                while offset < len(content):
                    offset, row_id, ids = parse_frame(content, offset)
                    arrays = [pa.array([row_id], pa.int64()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(arrays, ["id", "ids"])

    return _files(spark, folder).mapInArrow(run, "id bigint, ids array<bigint>")


def read_shuffled(spark: SparkSession, folder: str, seed: int, partitions: int) -> DataFrame:
    """Records in a repeatable random order: offsets go to their file, payloads come back in shuffled places."""
    spots = (
        spark.read.schema(_INDEX).parquet(f"{folder}/index")
        .select("file", "offset", F.xxhash64(F.lit(seed), "file", "offset").alias("place"))
        .groupBy("file").agg(F.collect_list(F.struct("offset", "place")).alias("spots"))  # one file's records
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, wanted in zip(batch.column(0), batch.column(1)):
                content = content.as_py()
                for spot in wanted.as_py():
                    _, row_id, ids = parse_frame(content, spot["offset"])
                    arrays = [
                        pa.array([spot["place"]], pa.int64()), pa.array([row_id], pa.int64()),
                        pa.array([ids.astype(np.int64)], pa.list_(pa.int64())),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, ["place", "id", "ids"])

    rows = _files(spark, folder).join(spots, "file").select("content", "spots")
    return (
        rows.mapInArrow(run, "place bigint, id bigint, ids array<bigint>")
        .repartitionByRange(partitions, "place").sortWithinPartitions("place").drop("place")
    )


def token_records(docs: DataFrame, path: str, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write records and index to a new folder in the shared scratch space; per record its place and checksum as read back."""
    spark, folder = docs.sparkSession, scratch_path(docs.sparkSession, "records")
    write_records(docs, folder, path, end_id, id_column, text_column)
    write_index(spark, folder)
    return read_index(spark, folder).select(F.col("id").alias(id_column), "start", "n_tokens", "ids_crc32", "file", "offset", "length")
