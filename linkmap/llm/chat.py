"""Chat formatting over a prefix tree of conversations.

Conversations that share their first turns share the nodes of those turns.  A
tree is written depth first as one token sequence: the tokens of a shared turn
stand in it once, with the position ids that they have in each conversation,
and with the intervals of the sequence that their ancestors fill, which are
all that they may attend to besides what stands before them in their own node.
Tokens are code points.

Conversations are sorted by their path of turn hashes and then by id, which is
the depth-first order, and are range-partitioned by that: a first turn that a
third of all conversations share, or a conversation that as many repeat, is
cut between tasks, at the price of writing the shared path once more for each
cut.  Nothing holds more than one path of a tree at a time; one
conversation, whose turns are one row there, is the largest unit that a task
holds.

Texts can hold anything: ``<|`` and its escapes get a backslash more, which
is taken away on reading, so no text forms a control string.  Loss falls on
the texts of assistant turns and nothing else.

Defined results: a null text or role is empty; turns are ordered by number,
nulls first, then role, then text; repeated rows are turns of their own; rows
without conv_id form one conversation without id; an empty table gives none;
other columns, whatever their names, aren't carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkmap.llm.common import tune

START, END = "<|im_start|>", "<|im_end|>"
#: A tree is cut when its sequence has so many tokens.
TREE_TOKENS = 1 << 20

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The formatted turn, and where its text starts in it."""
    head = f"{START}{escape_role(role)}\n"
    return f"{head}{escape(text)}{END}\n", len(head)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out = []
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        out.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return out


PATHS = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("path", T.BinaryType()),
    T.StructField("turns", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))),
])

TREE = T.StructType([
    T.StructField("tree", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("conv_id", T.LongType()),
    T.StructField("is_end", T.BooleanType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("tokens", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("position", T.LongType()),
    T.StructField("loss_start", T.LongType()),
    T.StructField("loss_end", T.LongType()),
    T.StructField("ancestors", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def _path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn: conversations with their path of turn hashes."""
    state: list = [None, None, None]  # id, path, turns
    begun = False

    def done(items: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{"conv_id": i, "path": bytes(p), "turns": t} for i, p, t in items],
            schema=pa.schema([("conv_id", pa.int64()), ("path", pa.binary()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]),
        )

    for b in batches:
        out = []
        for conv, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if not begun or conv != state[0]:
                if begun:
                    out.append(tuple(state))
                state, begun = [conv, bytearray(), []], True
            one = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=12).digest()
            state[1] += one
            state[2].append({"role": role, "text": text})
        if out:
            yield done(out)
    if begun:
        yield done([tuple(state)])


def _depth_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations in depth-first order: a row for each node, once, and one for each conversation's end."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    schema = pa.schema([
        ("tree", pa.string()), ("seq", pa.int64()), ("conv_id", pa.int64()), ("is_end", pa.bool_()), ("depth", pa.int32()), ("tokens", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("position", pa.int64()),
        ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("ancestors", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ])
    tree, seq, at = 0, 0, 0
    stack: list[tuple[tuple[str, str], int, int]] = []  # turn, start and end in the sequence

    def intervals() -> list[dict]:
        merged: list[dict] = []
        for _, a, b in stack:
            if merged and merged[-1]["end"] == a:
                merged[-1]["end"] = b
            else:
                merged.append({"start": a, "end": b})
        return merged

    for b in batches:
        rows = []
        for conv, turns in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            path = [(x["role"], x["text"]) for x in turns]
            same = 0
            while same < min(len(stack), len(path)) and stack[same][0] == path[same]:
                same += 1
            if same == 0 and at >= TREE_TOKENS or at >= 2 * TREE_TOKENS:
                tree, seq, at, stack, same = tree + 1, 0, 0, [], 0
            del stack[same:]
            position = sum(e - s for _, s, e in stack)
            for depth in range(same, len(path)):
                role, text = path[depth]
                tokens, head = format_turn(role, text)
                end = at + len(tokens)
                loss = (at + head, end - len(END) - 1) if role == "assistant" else (None, None)
                rows.append({"tree": f"{part}-{tree}", "seq": seq, "conv_id": None, "is_end": False, "depth": depth, "tokens": tokens, "start": at, "end": end, "position": position, "loss_start": loss[0], "loss_end": loss[1], "ancestors": intervals()})
                stack.append((path[depth], at, end))
                seq, position, at = seq + 1, position + len(tokens), end
            rows.append({"tree": f"{part}-{tree}", "seq": seq, "conv_id": conv, "is_end": True, "depth": len(path), "ancestors": intervals()})
            seq += 1
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def format_trees(conversations: DataFrame) -> DataFrame:
    """Node rows (``is_end`` false) and a row for each conversation's end, whose ancestors are all of its tokens."""
    spark = tune(conversations.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    paths = turns.repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "text").mapInArrow(_path, PATHS)
    return paths.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns").mapInArrow(_depth_first, TREE)


READ = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("n_turns", T.LongType()),
    T.StructField("turns_sha256", T.StringType()),
    T.StructField("loss_chars", T.LongType()),
    T.StructField("loss_sha256", T.StringType()),
    T.StructField("formatted_chars", T.LongType()),
])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tree and seq.  Only the nodes of the last conversation's path are held; the intervals say which stay."""
    tree, nodes = None, []  # (start, end, tokens, loss)
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["tree"] != tree:
                tree, nodes = r["tree"], []
            inside = [(x["start"], x["end"]) for x in r["ancestors"]]
            # the intervals name the path; whatever lies outside of them has been left
            last = inside[-1][1] if inside else 0
            while nodes and (nodes[-1][0] >= last or not any(a <= nodes[-1][0] < e for a, e in inside)):
                nodes.pop()
            if not r["is_end"]:
                nodes.append((r["start"], r["end"], r["tokens"], r["loss_start"], r["loss_end"]))
                continue
            if [sum(e - a for a, e in inside), r["depth"]] != [sum(x[1] - x[0] for x in nodes), len(nodes)]:
                raise ValueError(f"tree {tree}: the intervals of conversation {r['conv_id']} don't match its nodes")
            whole = "".join(x[2] for x in nodes)
            turns = parse(whole)
            loss = "".join(unescape(t[a - s : e - s]) for s, _, t, a, e in nodes if a is not None)
            digest = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
            out.append({"conv_id": r["conv_id"], "n_turns": len(turns), "turns_sha256": digest, "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(whole)})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))


def read_back(trees: DataFrame) -> DataFrame:
    """Each conversation rebuilt from a tree table, with digests of its turns and of what its loss mask covers."""
    parts = int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return trees.repartition(parts, "tree").sortWithinPartitions("tree", "seq").mapInArrow(_read, READ)
