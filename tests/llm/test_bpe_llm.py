"""Matrix BPE against the tiktoken library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve.llm import bpe
from mailsieve.llm.queries import RANKS, op1_byte_bpe
from mailsieve.llm.tokens import PieceTable, vocabulary_path

from .helpers import AWKWARD, DOCS, awkward, crowded, rows_of

PATH = vocabulary_path(RANKS)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def expected(library, rows):
    out = []
    for i, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        out.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    return sorted(out, key=repr)


def test_random_texts(library):
    rng = random.Random(3)
    model = bpe.MatrixBpe(PATH)
    wild = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2050), 0x4E00, 0x1F600, 0x301, 0xE000, 0xFFFF, 0x10FFFF, 0x3000, 0x661, 0x2160]]
    plain = list("ab 'stvrelmd\n\t.1é  ")
    texts = ["".join(rng.choices(wild if n % 2 else plain, k=rng.randint(0, 40))) for n in range(4000)]
    for text, ids in zip(texts, model.encode(texts)):
        got = np.frombuffer(ids, "<u4").tolist()
        assert got == library.encode_ordinary(text)
        assert model.decode(got) == text.encode()


def test_long_pieces_and_texts(library):
    model = bpe.MatrixBpe(PATH)
    rng = random.Random(5)
    texts = ["a" * 513, "ab" * 3000, "!?" * 700, "é" * 900, " " * 4000, "".join(rng.choices("abcdefgh", k=20_000)), "some words here " * 200_000]
    for text, ids in zip(texts, model.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_table_starts_anew(library):
    model = bpe.MatrixBpe(PATH)
    table = PieceTable(model.encode_pieces)
    table.max_entries = 50
    for n in range(40):
        text = " ".join(f"w{n}x{k}" for k in range(30))
        assert np.frombuffer(table.buffers([text])[0], "<u4").tolist() == library.encode_ordinary(text)
    assert table.entries < 200


def test_awkward_rows(spark, library):
    docs = awkward(spark)
    assert rows_of(bpe.round_trip(docs, PATH)) == expected(library, AWKWARD)
    assert rows_of(bpe.round_trip(crowded(docs), PATH)) == expected(library, AWKWARD)
    assert bpe.round_trip(spark.createDataFrame([], DOCS), PATH).collect() == []


def test_encode_then_decode(spark):
    back = bpe.decode_ids(bpe.encode_texts(awkward(spark), PATH), PATH)
    want = sorted(((i, bytearray((t or "").encode())) for i, t, *_ in AWKWARD), key=repr)
    assert rows_of(back) == want
    nulls = spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    assert [tuple(r) for r in bpe.decode_ids(nulls, PATH).collect()] == [(1, None)]


def test_query(spark, sf_dir, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(op1_byte_bpe(spark, sf_dir)) == expected(library, docs)


def test_plan_has_no_shuffle(spark, sf_dir):
    df = op1_byte_bpe(spark, sf_dir)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.agg(F.count("*")).first()[0] > 0


@pytest.mark.parametrize("pair", ["ab", "cx", "et"])
def test_pieces_of_equal_hash(library, pair):
    """Thue-Morse words and their complements share every polynomial hash modulo a power of two."""
    from tokenizers import Tokenizer

    from mailsieve.llm.tokens import LibraryEncoder

    def word(a, b, n):
        return a if n == 1 else word(a, b, n // 2) + word(b, a, n // 2)

    texts = [word(x, y, n) for n in (512, 1024, 4096) for x, y in (pair, pair[::-1])]
    path = vocabulary_path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    for order in (texts, texts[::-1]):
        for text, ids in zip(order, bpe.MatrixBpe(PATH).encode(order)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        for text, ids in zip(order, LibraryEncoder(path).buffers(order)):
            assert np.frombuffer(ids, "<u4").tolist() == other.encode(text, add_special_tokens=False).ids
