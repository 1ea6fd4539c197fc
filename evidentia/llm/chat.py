"""Chat formatting into prefix trees."""

from __future__ import annotations

import hashlib
import pickle
import re

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm._common import saved, small

#: The template's marks. A turn is START role SEP text END.
START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
#: Control strings of this and other common templates: an opening character and what follows it.
_CONTROL = r"(?=\||/?s>|/?INST\]|<SYS>>|</SYS>>)"
_ESCAPE, _UNESCAPE = re.compile(r"([<\[])(\\*)" + _CONTROL), re.compile(r"([<\[])\\(\\*)" + _CONTROL)
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    """One backslash more after the first character of each control string, so none is left; `unescape` takes it away."""
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render(role: str | None, text: str | None) -> tuple[str, tuple[int, int]]:
    """A turn as the template has it, and where its text stands there. Nulls count as empty."""
    head, body = START + escape(role or "") + SEP, escape(text or "")
    return head + body + END, (len(head), len(head) + len(body))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of what `render` made."""
    turns = [x.removeprefix(START).split(SEP, 1) for x in formatted.split(END)[:-1]]
    return [(unescape(role), unescape(text)) for role, text in turns]


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, leaf, path, turns) of (conv_id, turn, role, text): each turn's node is a digest of all turns up to it.

    Turns stand in the order of turn (nulls first), then role and text; rows with a null conv_id are one conversation."""
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))

    def nodes(batches):
        for batch in batches:
            rows = []
            for turns in batch.column("turns").to_pylist():
                node, out = b"", []
                for t in turns:
                    formatted, (a, b) = render(t["role"], t["text"])
                    parent, node = node, hashlib.md5(node + formatted.encode("utf-8", "surrogatepass")).digest()
                    out.append((node, parent or None, t["role"], formatted, len(formatted), a if t["role"] == LOSS_ROLE else None, b if t["role"] == LOSS_ROLE else None))
                rows.append({"leaf": node, "path": [x[0] for x in out], "lengths": [x[4] for x in out], "turns": [dict(zip(names, x)) for x in out]})
            made = pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(("leaf", "path", "lengths", "turns"), (pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(turn))))))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *made.columns], ["conv_id", *made.schema.names])

    names = ("node", "parent", "role", "formatted", "length", "loss_from", "loss_to")
    turn = pa.struct(list(zip(names, (pa.binary(), pa.binary(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()))))
    kind = turns.schema["conv_id"].dataType.simpleString()
    return whole.mapInArrow(nodes, f"conv_id {kind}, leaf binary, path array<binary>, lengths array<int>, turns array<struct<node:binary,parent:binary,role:string,formatted:string,length:int,loss_from:int,loss_to:int>>")


def _common(a, b) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _merged(intervals):
    out = []
    for a, b in intervals:
        if out and out[-1][1] == a:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def layout(paths: DataFrame) -> DataFrame:
    """(node, tree, depth, start, position, ancestors) for each node of the prefix trees of `paths` (path, lengths), distinct.

    Sorted paths are the trees in depth-first order: a path adds the nodes after what it shares with the path before it. The
    sort is by ranges. Each range sums up what it adds and where its first and last paths stand; the driver links these
    summaries, one for each range, and the ranges then give each node its place in its tree (start), its position id (the
    length of its ancestors) and the intervals of its tree that it attends to besides itself."""
    ordered = saved(paths.select("path", "lengths").where(F.size("path") > 0).repartitionByRange("path").sortWithinPartitions("path"))

    def summary(batches):
        first = last = starts = None
        total, shared = 0, 1 << 30
        for batch in batches:
            for path, lengths in zip(batch["path"], batch["lengths"]):
                path = [bytes(x) for x in path]
                k = 0 if last is None else _common(last, path)
                if last is None:
                    first, shared = (path, list(map(int, lengths))), 1 << 30
                else:
                    shared = min(shared, k)
                starts = (starts or [])[:k]
                for n in lengths[k:]:
                    starts.append(total)
                    total += int(n)
                last = path
        if last is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "facts": [pickle.dumps((first, last, starts, total, shared))]})

    known, base, stack = {}, 0, ([], [])
    for part, facts in sorted(ordered.mapInPandas(summary, "part int, facts binary").collect()):
        (path, lengths), last, starts, total, shared = pickle.loads(facts)
        k = _common(stack[0], path)
        shift = base - sum(lengths[:k])
        known[part] = (stack[0][:k], stack[1][:k], shift)
        kept = min(k, shared, len(last))
        stack = (last, stack[1][:kept] + [s + shift for s in starts[kept:]])
        base = shift + total
    known = paths.sparkSession.sparkContext.broadcast(known)

    def place(batches):
        last = starts = at = None
        for batch in batches:
            rows = []
            for path, lengths in zip(batch["path"], batch["lengths"]):
                path, lengths = [bytes(x) for x in path], list(map(int, lengths))
                if last is None:
                    last, starts, shift = known.value[TaskContext.get().partitionId()]
                    at = shift + sum(lengths[: len(last)])
                k = _common(last, path)
                starts = list(starts[:k])
                position = sum(lengths[:k])
                for depth in range(k, len(path)):
                    starts.append(at)
                    root = starts[0]
                    spans = _merged((s - root, s - root + n) for s, n in zip(starts[:-1], lengths))
                    rows.append((path[depth], path[0], depth, at - root, position, spans))
                    at += lengths[depth]
                    position += lengths[depth]
                last = path
            yield pd.DataFrame(rows, columns=["node", "tree", "depth", "start", "position", "ancestors"])

    return ordered.mapInPandas(place, "node binary, tree binary, depth int, start long, position long, ancestors array<struct<start:long,end:long>>")


def prefix_trees(convs: DataFrame) -> DataFrame:
    """One row per node: tree, node, parent, depth, role, text (formatted), length, start, position, ancestors, loss_from and
    loss_to (the part of an assistant's turn that is trained on). `convs` is what `conversations` gives.

    In order of start, the rows of a tree are its tokens (code points), each shared turn once, depth first. Position ids of a
    row run from `position`; its tokens attend to `ancestors` and to those before them in the row."""
    leaves = convs.groupBy("leaf").agg(F.first("path").alias("path"), F.first("lengths").alias("lengths"))
    turns = convs.select(F.explode("turns").alias("t")).select("t.*").groupBy("node", "parent", "role", "formatted", "length", "loss_from", "loss_to").count().drop("count")
    return layout(leaves).join(turns, "node").select("tree", "node", "parent", "depth", "role", F.col("formatted").alias("text"), "length", "start", "position", "ancestors", "loss_from", "loss_to")


def read_back(convs: DataFrame, trees: DataFrame) -> DataFrame:
    """(leaf, text, loss) of each distinct conversation, from the trees: its formatted text and the unescaped text under the
    loss mask. The nodes of a conversation are its path. A conversation without turns has no tree."""
    paths = convs.groupBy("leaf").agg(F.first("path").alias("path")).select("leaf", F.explode("path").alias("node"))
    parts = paths.join(trees, "node").groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("depth", "text", "loss_from", "loss_to"))).alias("parts"))

    def decode(batches):
        for batch in batches:
            texts = ["".join(p["text"] for p in parts) for parts in batch["parts"]]
            loss = ["".join(unescape(p["text"][int(p["loss_from"]) : int(p["loss_to"])]) for p in parts if p["loss_from"] is not None) for parts in batch["parts"]]
            yield pd.DataFrame({"leaf": batch["leaf"], "text": texts, "loss": loss})

    return parts.mapInPandas(decode, "leaf binary, text string, loss string")


def chat_digest(turns: DataFrame) -> DataFrame:
    """One row per conversation of `turns` (conv_id, turn, role, text): conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, all read back from the trees.

    Null texts and roles count as empty; an empty table gives an empty result; other columns are ignored."""
    convs = saved(conversations(turns.select("conv_id", "turn", "role", "text")))
    back = read_back(convs, prefix_trees(convs))

    def digest(batches):
        for batch in batches:
            rows = []
            for text, loss in zip(batch["text"], batch["loss"]):
                turns = parse(text)
                sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((len(turns), sha, len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            yield pd.concat([batch[["leaf"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])], axis=1)

    digests = saved(back.mapInPandas(digest, "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))
    return convs.select("conv_id", "leaf").join(small(digests), "leaf").drop("leaf")
