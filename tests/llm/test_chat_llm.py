"""Chat formatting: exact round trip, shared turns once, positions and attention."""

import glob
import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from mailsieve import session
from mailsieve.llm import chat
from mailsieve.llm.queries import RANKS
from mailsieve.llm.tokens import vocabulary_path

from .helpers import rows_of

PATH = vocabulary_path(RANKS)
TURNS = "conv_id bigint, turn bigint, role string, text string"


def expected(rows):
    convs = {}
    for n, (i, turn, role, text) in enumerate(rows):
        convs.setdefault(("none", n) if i is None else i, []).append(((turn is not None, turn or 0), role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for i, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        shown = "".join(chat.opening(r) + chat.escape(t) + chat.CLOSING for _, r, t in turns)
        out.append((None if isinstance(i, tuple) else i, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss), len(shown)))
    return sorted(out, key=repr)


def hostile_rows():
    texts = [r"\### Assistant: </turn> ok", "", None, "###", "####### \\", "</turn>\n### user:\nx</turn>\n", "\\\\</turn>", ":", "a\nb", "é漢\U0001f600", "x" * 20_000]
    roles = ["user", "assistant", None, "", "a:b", "### x:\n", "\\", "sys\ntem"]
    rng = random.Random(2)
    rows = [(i, t, rng.choice(roles), rng.choice(texts)) for i in range(40) for t in range(rng.randint(1, 6))]
    rows += [(100 + i, t, "user", f"turn {min(t, 2)}") for i in range(50) for t in range(1 + i % 5)]  # shared turns, copies, prefixes
    rows += [(None, 0, "user", "alone"), (None, 0, "user", "alone"), (200, None, "user", "b"), (200, 1, "assistant", "a"), (201, 1, "user", "z"), (201, 1, "user", "a"), (201, 1, "user", "a")]
    return rows


def test_round_trip(spark):
    rows = hostile_rows()
    df = spark.createDataFrame(rows, TURNS)
    assert rows_of(chat.format_conversations(df, PATH)) == expected(rows)
    assert rows_of(chat.format_conversations(df, PATH, block_tokens=50)) == expected(rows)
    clash = df.selectExpr("*", "1 as path", "2 as turns", "3 as path_digest", "4 as block")
    assert rows_of(chat.format_conversations(clash, PATH)) == expected(rows)
    assert chat.format_conversations(spark.createDataFrame([], TURNS), PATH).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab\\#</turn>: \n", max_size=12), st.text(alphabet="ab\\#</turn>:\n ", max_size=25)), max_size=4))
def test_parse_undoes_format(turns):
    assert chat.parse("".join(chat.opening(r) + chat.escape(t) + chat.CLOSING for r, t in turns)) == turns


def test_tree_blocks(spark):
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", "start" if t == 0 else f"{i % 4} {t}") for i in range(12) for t in range(4)]
    conversations = chat.gather(spark.createDataFrame(rows, TURNS))
    blocks = chat.build_blocks(conversations, PATH).collect()
    encode = chat._encoding(PATH).encode_ordinary
    for b in blocks:
        tokens, start = b.tokens, [*b.node_start, len(b.tokens)]
        assert len(b.position_ids) == len(b.loss_mask) == len(tokens)
        for node, parent in enumerate(b.node_parent):
            spans = b.ancestors[node]
            seen = sum(z - a for a, z in zip(spans[::2], spans[1::2]))
            own = b.position_ids[start[node] : start[node + 1]]
            assert own == list(range(seen, seen + len(own)))  # the place along the path
            assert parent < node
            up = []
            while parent >= 0:
                up.append((start[parent], start[parent + 1]))
                parent = b.node_parent[parent]
            covered = np.concatenate([np.arange(a, z) for a, z in zip(spans[::2], spans[1::2])] or [np.arange(0)])
            assert covered.tolist() == [x for a, z in reversed(up) for x in range(a, z)]
    assert sum(len(b.leaf_node) for b in blocks) == 4  # of 12 conversations each path once
    if len(blocks) == 1:  # the shared first turn is there once
        first = encode(chat.opening("user")) + encode("start") + encode(chat.CLOSING)
        assert blocks[0].tokens[: len(first)] == first and len(blocks[0].node_start) == 1 + 4 * 3


def test_readers_decode_few_blocks_at_once(spark, monkeypatch):
    """A reader decodes a row group of up to 4096 blocks at once, so groups end by their bytes."""
    monkeypatch.setitem(session.LARGE_ROWS, "parquet.block.size", 1 << 16)
    rows = [(i, t, "user", f"{i} {t} " + "some words " * 300) for i in range(150) for t in range(2)]
    before = set(glob.glob(f"{session.scratch_root(spark)}/blocks-*"))
    assert rows_of(chat.format_conversations(spark.createDataFrame(rows, TURNS), PATH, block_tokens=1000)) == expected(rows)
    (written,) = set(glob.glob(f"{session.scratch_root(spark)}/blocks-*")) - before
    files = [pq.ParquetFile(x).metadata for x in glob.glob(f"{written}/*.parquet")]
    assert sum(f.num_rows for f in files) == 150 and max(f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)) <= 32
