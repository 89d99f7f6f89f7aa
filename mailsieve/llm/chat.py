"""Conversations as prefix trees: shared first turns are emitted once.

Template of a turn: ``### role:`` and a line feed, the text, ``</turn>`` and a line feed. In texts a backslash goes before
every backslash, ``###`` and ``</turn>``, in roles before colons too, which ``unescape`` undoes exactly.

1. The turns of a conversation make one row, in turn order. Its path is the list of digests of its turns.
2. Equal paths become one row by an aggregation; ids of conversations keep only the digest of their path.
3. Paths are dealt by range and sorted, so that conversations with the same first turns stand together, and a third
   of all rows under one first turn still spreads over many tasks. A task walks its sorted paths and builds blocks of
   about ``block_tokens`` tokens (one conversation at least): each new turn is a node whose tokens follow its parent's,
   depth first. A block that starts inside a tree emits the shared turns again once.
4. A block row holds tokens, position ids counted along each path, the loss mask (texts of ``assistant`` turns), and
   for every node its range, its parent and the intervals of its ancestors' tokens, joined where they touch.

Defined results: null roles and texts are empty; equal turn numbers follow by role, then text, and null turns come first;
rows without a conversation id are conversations of one turn each, with a null id; an empty table gives no rows;
other columns are ignored. A conversation is one record: it has to fit into a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.session import materialize

_ESCAPE = re.compile(r"\\|###|</turn>")
_ROLE_ESCAPE = re.compile(r"\\|###|</turn>|:")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|:)")
_TEXT_END = re.compile(r"\\(?:\\|###|</turn>|:)|</turn>\n")
_ROLE_END = re.compile(r"\\(?:\\|###|</turn>|:)|:\n")

BLOCKS = (
    "block bigint, tokens array<int>, position_ids array<int>, loss_mask array<tinyint>, node_start array<int>, "
    "node_parent array<int>, ancestors array<array<int>>, leaf_node array<int>, leaf_path array<string>"
)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def opening(role: str) -> str:
    return "### " + _ROLE_ESCAPE.sub(r"\\\g<0>", role) + ":\n"


CLOSING = "</turn>\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; raises on anything else."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith("### ", at):
            raise ValueError(f"no turn at character {at}")
        parts = []
        at += 4
        for ends, control in ((_ROLE_END, ":\n"), (_TEXT_END, CLOSING)):
            stop = next((m for m in ends.finditer(formatted, at) if m[0] == control), None)
            if stop is None:
                raise ValueError(f"turn without an end at character {at}")
            parts.append(unescape(formatted[at : stop.start()]))
            at = stop.end()
        turns.append(tuple(parts))
    return turns


_encodings: dict[str, object] = {}


def _encoding(path: str):
    if path not in _encodings:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def gather(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, its turns in order, their digests as ``path`` and the path's digest."""
    rows = turns.select(turns["conv_id"], turns["turn"], F.coalesce(turns["role"], F.lit("")).alias("role"), F.coalesce(turns["text"], F.lit("")).alias("text"))
    one = F.struct("turn", "role", "text")
    many = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    # array_sort puts nulls of a struct field first
    convs = many.unionByName(rows.filter("conv_id is null").select("conv_id", F.array(one).alias("turns")))
    path = F.transform("turns", lambda t: F.md5(F.concat_ws("\n", F.length(t["role"]).cast("string"), t["role"], t["text"])))
    return convs.withColumn("path", path).withColumn("path_digest", F.md5(F.concat_ws(",", "path")))


class Block:
    """Nodes of one block in depth-first order."""

    def __init__(self):
        self.tokens, self.positions, self.loss = [], [], []
        self.start, self.end, self.parent, self.depth, self.ancestors = [], [], [], [], []
        self.leaves: list[tuple[int, str]] = []

    def add(self, parent: int, parts: list[tuple[list[int], bool]]) -> int:
        begin, depth = len(self.tokens), 0 if parent < 0 else self.depth[parent]
        for ids, trained in parts:
            self.tokens += ids
            self.loss += [int(trained)] * len(ids)
        size = len(self.tokens) - begin
        self.positions += range(depth, depth + size)
        spans = []
        if parent >= 0:
            spans = [*self.ancestors[parent]]
            if spans and spans[-1] == self.start[parent]:
                spans[-1] = self.end[parent]
            else:
                spans += [self.start[parent], self.end[parent]]
        self.start.append(begin)
        self.end.append(begin + size)
        self.parent.append(parent)
        self.depth.append(depth + size)
        self.ancestors.append(spans)
        return len(self.start) - 1

    def row(self, number: int) -> pa.RecordBatch:
        nodes, paths = zip(*self.leaves)
        ints, kind = pa.list_(pa.int32()), pa.int32()
        values = [
            pa.array([number], pa.int64()), pa.array([np.array(self.tokens, np.int32)], ints),
            pa.array([np.array(self.positions, np.int32)], ints), pa.array([np.array(self.loss, np.int8)], pa.list_(pa.int8())),
            pa.array([self.start], ints), pa.array([self.parent], ints), pa.array([self.ancestors], pa.list_(pa.list_(kind))),
            pa.array([list(nodes)], ints), pa.array([list(paths)], pa.list_(pa.string())),
        ]
        return pa.RecordBatch.from_arrays(values, [c.split(" ")[0] for c in BLOCKS.replace("array<array<int>>", "a").split(", ")])


def build_blocks(conversations: DataFrame, path: str, block_tokens: int = 16_384) -> DataFrame:
    """Blocks of prefix trees from the rows of ``gather``; equal conversations are one leaf."""
    distinct = conversations.groupBy("path").agg(F.first("path_digest").alias("digest"), F.first("turns").alias("turns"))
    ordered = distinct.repartitionByRange("path").sortWithinPartitions("path").select("path", "digest", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        number, block, open_path, open_nodes = TaskContext.get().partitionId() << 32, Block(), [], []
        for batch in batches:
            for steps, digest, turns in zip(*(batch.column(i) for i in range(3))):
                steps, turns = steps.as_py(), turns.as_py()
                shared = 0
                while shared < min(len(steps), len(open_path)) and steps[shared] == open_path[shared]:
                    shared += 1
                parts = [
                    [(encode(opening(t["role"])), False), (encode(escape(t["text"])), t["role"] == "assistant"), (encode(CLOSING), False)]
                    for t in turns[shared:]
                ]
                if block.leaves and len(block.tokens) + sum(len(ids) for p in parts for ids, _ in p) > block_tokens:
                    yield block.row(number)
                    number, block, open_path, open_nodes = number + 1, Block(), [], []
                    parts = [
                        [(encode(opening(t["role"])), False), (encode(escape(t["text"])), t["role"] == "assistant"), (encode(CLOSING), False)]
                        for t in turns
                    ]
                    shared = 0
                open_path, open_nodes = open_path[:shared], open_nodes[:shared]
                for step, p in zip(steps[shared:], parts):
                    open_nodes.append(block.add(open_nodes[-1] if open_nodes else -1, p))
                    open_path.append(step)
                block.leaves.append((open_nodes[-1], digest.as_py()))
        if block.leaves:
            yield block.row(number)

    return ordered.mapInArrow(run, BLOCKS)


def read_blocks(blocks: DataFrame, path: str) -> DataFrame:
    """Digests of every leaf's conversation, decoded from the tokens that its last node may attend to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoding(path).decode_bytes
        for batch in batches:
            for n in range(batch.num_rows):  # block by block, as a batch may hold many
                row = {c: batch.column(c)[n] for c in ("tokens", "loss_mask", "node_start", "ancestors", "leaf_node", "leaf_path")}
                tokens, loss = row["tokens"].values.to_numpy(), row["loss_mask"].values.to_numpy().astype(bool)
                start, out = [*row["node_start"].as_py(), len(tokens)], []
                for node, digest in zip(row["leaf_node"].as_py(), row["leaf_path"].as_py()):
                    spans = [*row["ancestors"][node].as_py(), start[node], start[node + 1]]
                    at = np.concatenate([np.arange(a, b) for a, b in zip(spans[::2], spans[1::2])])
                    formatted = decode(tokens[at].tolist()).decode()
                    mask = loss[at]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                    trained = "".join(unescape(decode(tokens[at[a:b]].tolist()).decode()) for a, b in zip(edge[::2], edge[1::2]))
                    turns = parse(formatted)
                    whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                    out.append((digest, len(turns), sha(whole), len(trained), sha(trained), len(formatted)))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(zip(*out), kinds)],
                    ["path_digest", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
                )

    schema = "path_digest string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    # The same path may be the leaf of one block only: equal paths are one row of one task.
    return blocks.mapInArrow(run, schema)


def format_conversations(turns: DataFrame, path: str, block_tokens: int = 16_384) -> DataFrame:
    """Write the blocks, read them back and return the digests of every conversation."""
    conversations = materialize(gather(turns), "conversations", large_rows=True)
    blocks = materialize(build_blocks(conversations, path, block_tokens), "blocks", large_rows=True)
    found = materialize(read_blocks(blocks, path), "leaves")
    return conversations.select("conv_id", "path_digest").join(found, "path_digest").drop("path_digest")
