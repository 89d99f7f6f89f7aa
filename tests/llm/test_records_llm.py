"""Binary records against the tokenizers library, and damage."""

import zlib

import numpy as np
import pytest

from mailsieve.llm import records
from mailsieve.llm.queries import VOCABULARY, op4_binary_records
from mailsieve.llm.tokens import library_tokenizer, vocabulary_path
from mailsieve.session import scratch_path

from .helpers import AWKWARD, DOCS, awkward, crowded, rows_of

PATH = vocabulary_path(VOCABULARY)


def expected(rows):
    tokenizer = library_tokenizer(PATH)
    ids = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows]
    ids.sort(key=lambda r: (r[0] is not None, r[0] or 0, len(r[1])))
    out, start = [], 0
    for i, x in ids:
        out.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    return sorted(out, key=repr)


def shown(df):
    return rows_of(df.select("doc_id", "start", "n_tokens", "ids_crc32"))


def test_awkward_rows(spark):
    want = expected([(r[0], r[1]) for r in AWKWARD])
    assert shown(records.token_records(awkward(spark), PATH)) == want
    assert shown(records.token_records(crowded(awkward(spark)), PATH)) == want
    assert records.token_records(spark.createDataFrame([], DOCS), PATH).collect() == []


def test_many_files_and_shuffled_read(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "records")
    records.write_records(docs, folder, PATH, file_chars=20_000)
    records.write_index(spark, folder)
    want = expected([tuple(r) for r in docs.select("doc_id", "text").collect()])
    index = records.read_index(spark, folder)
    assert rows_of(index.select("id", "start", "n_tokens", "ids_crc32")) == want
    assert index.select("file").distinct().count() > 5
    straight = [(r.id, tuple(r.ids)) for r in records.read_records(spark, folder).collect()]
    mixed = [(r.id, tuple(r.ids)) for r in records.read_shuffled(spark, folder, 5, 3).collect()]
    assert sorted(straight) == sorted(mixed) and straight != mixed
    assert [r for r in mixed] == [(r.id, tuple(r.ids)) for r in records.read_shuffled(spark, folder, 5, 3).collect()]


def test_damage_is_found():
    good = records.frame(5, np.arange(4), 2) + b"\n"
    assert records.parse_frame(good, 0)[1:][0] == 5
    for place in range(len(good)):
        bad = bytearray(good)
        bad[place] ^= 16
        with pytest.raises(ValueError):
            records.parse_frame(bytes(bad), 0)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert shown(op4_binary_records(spark, sf_dir)) == expected([tuple(r) for r in docs.collect()])
