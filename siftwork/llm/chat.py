"""Chat formatting over a prefix tree.

Conversations that begin with the same turns share the nodes of a prefix tree. A node's identity
is the digest of the turns from the root to it; in the order of these paths the tree is met depth
first. Conversations are dealt to tasks by ranges of that order, so a first turn that a third of
all conversations share is split like any other. A task packs its conversations one after the
other: turns that the last one already emitted are not emitted again, and a pack that has grown
to ``PACK`` characters ends, so the ancestors are emitted anew at the start of the next.

A node has its place in the pack, its position ids (those of its path alone, so that every
conversation is numbered as if it stood by itself) and the intervals of its ancestors, which with
the node itself are all that it may attend to. The loss mask covers the assistant's texts.

Defined cases: a null text or role is empty; turns are ordered by turn, role and text, null
first; rows that are repeated are turns of their own; a row without a conversation id belongs to no other
and is a conversation by itself; an empty table gives no packs. A conversation is one training example and is held
as a whole by the task that formats it; conversations are never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm._common import let, materialize, workspace

#: Characters after which a pack takes no further conversation.
PACK = 1 << 17
#: The template's control strings. Texts and roles can't hold them, as "<" and the escape sign are escaped there.
OPEN, MIDDLE, CLOSE = "<|start|>", "<|text|>", "<|end|>"
ESCAPES = (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"))
SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
NODE = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("parent", pa.int32()), ("position", pa.int64()), ("loss", SPAN), ("attends", pa.list_(SPAN))])
PACKS = pa.schema([("text", pa.string()), ("nodes", pa.list_(NODE)), ("members", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])))])
PACK_SCHEMA = "text string, nodes array<struct<start:long,stop:long,parent:int,position:long,loss:struct<start:long,stop:long>,attends:array<struct<start:long,stop:long>>>>, members array<struct<conv_id:long,node:int>>"


def escape(text: str) -> str:
    for plain, safe in ESCAPES:
        text = text.replace(plain, safe)
    return text


def unescape(text: str) -> str:
    out, at = [], 0
    while (k := text.find("\\", at)) >= 0:
        out += [text[at:k], {"\\": "\\", "l": "<", "b": "["}[text[k + 1]]]
        at = k + 2
    return "".join(out) + text[at:]


def render(role: str, text: str) -> tuple[str, int, int]:
    """(the turn as formatted, start and end of its text)."""
    head = f"{OPEN}{escape(role)}{MIDDLE}"
    safe = escape(text)
    return f"{head}{safe}{CLOSE}\n", len(head), len(head) + len(safe)


class Pack:
    """One packed sequence while it grows; ``path`` holds (turn, node) of the last conversation."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size, self.nodes, self.members, self.path = 0, [], [], []

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        common = 0
        while common < min(len(turns), len(self.path)) and self.path[common][0] == turns[common]:
            common += 1
        del self.path[common:]
        for role, text in turns[common:]:
            parent = self.path[-1][1] if self.path else -1
            shown, a, b = render(role, text)
            position = 0 if parent < 0 else self.nodes[parent]["position"] + self.nodes[parent]["stop"] - self.nodes[parent]["start"]
            start = self.size
            attends = [{"start": self.nodes[n]["start"], "stop": self.nodes[n]["stop"]} for _, n in self.path]
            # ancestors that lie side by side are one interval
            joined: list[dict] = []
            for x in attends:
                if joined and joined[-1]["stop"] == x["start"]:
                    joined[-1]["stop"] = x["stop"]
                else:
                    joined.append(x)
            loss = {"start": start + a, "stop": start + b} if role == "assistant" else None
            self.nodes.append({"start": start, "stop": start + len(shown), "parent": parent, "position": position, "loss": loss, "attends": joined})
            self.parts.append(shown)
            self.size += len(shown)
            self.path.append(((role, text), len(self.nodes) - 1))
        self.members.append({"conv_id": conv_id, "node": self.path[-1][1] if self.path else -1})

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"text": "".join(self.parts), "nodes": self.nodes, "members": self.members}], schema=PACKS)


def format_conversations(conversations: DataFrame, pack: int = PACK) -> DataFrame:
    """One row a pack: its text, its nodes and which node each conversation ends at."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    said = lambda turns: F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    convs = rows.where("conv_id is not null").groupBy("conv_id").agg(said(F.sort_array(F.collect_list("t"))).alias("turns"))
    convs = convs.unionByName(rows.where("conv_id is null").select("conv_id", said(F.array("t")).alias("turns")))

    # digests of the turns up to each, in a string that sorts paths depth first
    def grown(acc: Column, t: Column) -> Column:
        digest = F.sha2(F.concat_ws("\x00", acc["last"], F.sha2(t["role"], 256), F.sha2(t["text"], 256)), 256)
        return let(digest, lambda d: F.struct(d.alias("last"), F.concat(acc["path"], F.substring(d, 1, 16)).alias("path")))

    path = F.aggregate("turns", F.struct(F.lit("").alias("last"), F.lit("").alias("path")), grown, lambda acc: acc["path"])
    ordered = convs.withColumn("path", path).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns")

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Pack()
        for batch in batches:
            for k in range(batch.num_rows):
                now.add(batch.column(0)[k].as_py(), [(t["role"], t["text"]) for t in batch.column(1)[k].as_py()])
                if now.size >= pack:
                    yield now.batch()
                    now = Pack()
        if now.members:
            yield now.batch()

    return ordered.mapInArrow(packs, PACK_SCHEMA)


def read_back(packs: DataFrame) -> DataFrame:
    """Every conversation as the packs alone tell it: along the parents of its last node, by the template's marks and the loss mask."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        for batch in batches:
            for k in range(batch.num_rows):
                text, nodes, members = (c[k].as_py() for c in batch.columns)
                known: dict[int, tuple[bytes, str, int]] = {}

                def node(n: int) -> tuple[bytes, str, int]:
                    if n not in known:
                        x = nodes[n]
                        shown = text[x["start"] : x["stop"]]
                        role, _, said = shown.removeprefix(OPEN).removesuffix(f"{CLOSE}\n").partition(MIDDLE)
                        loss = unescape(text[x["loss"]["start"] : x["loss"]["stop"]]) if x["loss"] else ""
                        known[n] = (f"{unescape(role)}\n{unescape(said)}\n".encode(), loss, len(shown))
                    return known[n]

                rows = []
                for m in members:
                    path, n = [], m["node"]
                    while n >= 0:
                        path.append(n)
                        n = nodes[n]["parent"]
                    turns, loss, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0
                    for n in reversed(path):
                        raw, part, shown = node(n)
                        turns.update(raw)
                        loss.update(part.encode())
                        chars, size = chars + len(part), size + shown
                    rows.append((m["conv_id"], len(path), turns.hexdigest(), chars, loss.hexdigest(), size))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=list(names))

    return packs.mapInArrow(parsed, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def roundtrip(conversations: DataFrame) -> DataFrame:
    """Formats the conversations into packs in the shared folder, and reads them back."""
    return read_back(materialize(format_conversations(conversations), workspace(conversations.sparkSession, "chat")))
