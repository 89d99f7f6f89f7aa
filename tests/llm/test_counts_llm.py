"""Token counts against the tokenizers library."""

import random

import pytest
from tokenizers import Tokenizer

from mailsieve.llm import counts
from mailsieve.llm.tokens import vocabulary_path

from .helpers import awkward, crowded, rows_of

PATH = vocabulary_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def thue_morse(a, b, n):
    word = a
    while len(word) < n:
        word += word.translate({ord(a): b, ord(b): a})
    return word


def test_odd_texts(library):
    texts = [
        "", " ", "a", "  two  blanks\n\n\tand tabs ", "it's we'll 'tis", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|",
        "漢字かな混じり文 <|endoftext|> ꙮ́\U0001f600", "\x00\x01\x7f", "x" * 3000, "ab" * 2000, "é" * 999, " " * 2000 + "end", " 　  ",
    ]
    rng = random.Random(3)
    letters = "abcde  \n'’éß漢\U0001f600<|endoftext|>09#$\t"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(400)]
    assert counts.counter(PATH).counts(texts).tolist() == [want(library, t) for t in texts]


@pytest.mark.parametrize("pair", ["ab", "cx", "et"])
def test_pieces_of_equal_hash(library, pair):
    texts = [thue_morse(x, y, n) for n in (512, 1024, 4096) for x, y in (pair, pair[::-1])]
    assert counts.counter(PATH).counts(texts).tolist() == [want(library, t) for t in texts]


def test_pieces_by_plain_merging():
    """The heap against merging the leftmost lowest pair again and again."""
    c, rng = counts.PairCounter(PATH), random.Random(5)
    for _ in range(300):
        piece = bytes(rng.choice(b"abcdeinorst aeou") for _ in range(rng.randrange(1, 40)))
        symbols = [c.symbol[b] for b in piece]
        while True:
            found = [(c.joins[k][0], i, c.joins[k][1]) for i in range(len(symbols) - 1) if (k := symbols[i] << 32 | symbols[i + 1]) in c.joins]
            if not found:
                break
            _, i, joined = min(found)
            symbols[i : i + 2] = [joined]
        assert c.count(piece) == len(symbols)


def test_table(spark, library):
    docs = awkward(spark)
    got = rows_of(counts.count_tokens(docs, PATH, limit=6))
    data = [(r["doc_id"], len((r["text"] or "").encode()), want(library, r["text"] or "")) for r in docs.collect()]
    assert got == sorted(((*d, d[2] > 6) for d in data), key=repr)
    assert rows_of(counts.count_tokens(crowded(docs), PATH, limit=6)) == got
    assert counts.count_tokens(docs.limit(0), PATH).collect() == []


def test_whole_table(spark, sf_dir, library):
    from mailsieve.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    data = sorted((d, len((t or "").encode()), n := want(library, t or ""), n > 1024) for d, t in docs)
    assert sorted(map(tuple, QUERIES["op11_pair_counts"](spark, sf_dir).collect())) == data


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="no plain byte-level"):
        counts.PairCounter(vocabulary_path("word_bpe_49k.json"))
