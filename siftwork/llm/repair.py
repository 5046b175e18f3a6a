"""Repair of the structure of conversations, by edit distance to a regular language with block tables.

A sound conversation's role initials are ``(s?(ua)+)?``. Keeping a row costs 0, another role 3,
deleting 4, an inserted empty turn 3, a truncated text that stays 3 more; blank and duplicate
rows must be deleted. The language's automaton has four states (nothing yet, after a system turn,
after a user, after an assistant), so what remains of a conversation is known by four costs: the
least from each state to a sound end. Less their minimum these vectors are few, as two insertions
lead from any state to any other; they are found once by closure and numbered.

Rows are symbols (initial, truncated or not, to be deleted). For every vector and every block of
``BLOCK`` symbols a table holds the vector before the block and what is added to the costs, so a
conversation is read from its end, a block a step, by look-up. For the trace each block is
expanded backward from the vector behind it, and the edits are chosen forward, the ASCII-least of
the cheapest first: with the costs of all rests known, this gives the least of all cheapest
audits, also where blocks meet.

Rows are ordered by ranges of (conversation, turn), so one conversation may be cut into segments,
as many as there are ranges. For each segment the tables give its effect on every vector and the
trace gives its effect on every state; both are combined along the conversation's segments.
Digests of a repaired text are made in order, so a conversation streams through one task for
them, row by row.

Defined cases: a null role or text, and a null id or turn in the damage's key, is one space; rows without
an id are one conversation; null turns come first; equal turns are in the order of role and of the text's digest; a conversation without
rows has cost 0 and an empty audit; repeated rows are duplicates; an initial other than s, u, a
(case matters) can't be kept; an empty table gives an empty result; columns beyond the four are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm._common import materialize, workspace

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Symbols of a block: 10 ** BLOCK blocks have an entry for each vector.
BLOCK = 3
#: Initials that can be kept; symbols are initial (of four, the last for all others) + 4 if truncated, then deletion, then padding.
INITIALS, GONE, PAD = "sua", 8, 9
SYMBOLS = 10
#: State after an edit that leaves a turn: rows are states (start, s, u, a), columns the turn's initial.
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The only turn that can be written from each state, by another role or by insertion.
NEXT = ("u", "u", "a", "u")
SOUND = (0, 3)
FAR = 1 << 20
ROLES = {"s": "system", "u": "user", "a": "assistant"}
_BLANK = r"\x20\x09-\x0D"


def edits(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of what can be done to a row, without insertions, in ASCII order."""
    extra = TRUNCATED if 4 <= symbol < GONE else 0
    out = [("D", DELETE, state)]
    if symbol < GONE:
        kept = AFTER.get((state, INITIALS[symbol % 4])) if symbol % 4 < 3 else None
        if kept is not None:
            out.append(("K", extra, kept))
        out.append(("R", REROLE + extra, AFTER[state, NEXT[state]]))
    return out


def settle(costs: list[int]) -> tuple[int, ...]:
    """``costs`` after insertions: each state's least cost, perhaps by way of others."""
    costs = list(costs)
    for _ in range(4):
        for state in range(4):
            costs[state] = min(costs[state], INSERT + costs[AFTER[state, NEXT[state]]])
    return tuple(costs)


def before(vector: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs in front of a row from those behind it."""
    if symbol == PAD:
        return vector
    return settle([min(cost + vector[to] for _, cost, to in edits(state, symbol)) for state in range(4)])


@dataclass
class Tables:
    """``vectors`` less their minima, the last one's number ``end``; ``step`` and ``added`` by (vector, block)."""

    vectors: list[tuple[int, ...]]
    one: list[list[tuple[int, int]]]
    step: np.ndarray
    added: np.ndarray
    end: int
    end_cost: int

    def blocks(self, symbols: bytes) -> np.ndarray:
        """Numbers of the blocks; padding comes in front, where it changes nothing."""
        s = np.frombuffer(symbols.rjust(-(-len(symbols) // BLOCK) * BLOCK, bytes([PAD])), np.uint8).reshape(-1, BLOCK)
        return s @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))

    def through(self, symbols: bytes) -> tuple[list[int], list[int]]:
        """For every vector behind ``symbols``: the vector in front, and what is added."""
        at, added = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for b in self.blocks(symbols)[::-1]:
            added += self.added[at, b]
            at = self.step[at, b]
        return at.tolist(), added.tolist()

    def behind(self, symbols: bytes, vector: int) -> list[int]:
        """The vector behind each row, from that behind the last: block by block, each then expanded backward."""
        blocks, ends = self.blocks(symbols), []
        for b in blocks[::-1].tolist():
            ends.append(vector)
            vector = int(self.step[vector, b])
        pad = len(blocks) * BLOCK - len(symbols)
        out: list[int] = [0] * (len(blocks) * BLOCK)
        for k, v in enumerate(reversed(ends)):
            for at in range((k + 1) * BLOCK - 1, max(k * BLOCK, pad) - 1, -1):
                out[at] = v
                v = self.one[v][symbols[at - pad]][0]
        return out[pad:]

    def trace(self, symbols: bytes, behind: list[int], state: int, last: bool) -> tuple[str, int]:
        """(the least of the cheapest audits from ``state``, the state after it). ``last``: nothing follows, so insertions end it."""
        audit = []
        for symbol, v in zip(symbols, behind):
            rest = self.vectors[v]
            now = before(rest, symbol)
            while True:
                found = [(c, to, 0) for c, cost, to in edits(state, symbol) if cost + rest[to] == now[state]]
                to = AFTER[state, NEXT[state]]
                if INSERT + now[to] == now[state]:
                    found.append(("I", to, 1))
                edit, state, again = min(found)
                audit.append(edit)
                if not again:
                    break
        while last and state not in SOUND:
            audit.append("I")
            state = AFTER[state, NEXT[state]]
        return "".join(audit), state


@lru_cache(maxsize=1)
def tables() -> Tables:
    less = lambda v: tuple(c - min(v) for c in v)
    last = settle([0 if s in SOUND else FAR for s in range(4)])
    vectors = [less(last)]
    number = {vectors[0]: 0}
    one = []
    for v in vectors:  # grows while it is read
        row = []
        for symbol in range(SYMBOLS):
            to = before(v, symbol)
            if less(to) not in number:
                number[less(to)] = len(vectors)
                vectors.append(less(to))
            row.append((number[less(to)], min(to)))
        one.append(row)
    single = np.array(one)
    step, added = single[:, :, 0], single[:, :, 1]
    for _ in range(BLOCK - 1):  # one more symbol in front: the old block is read first, as costs come from the end
        nxt, more = single[:, :, 0][step], single[:, :, 1][step]  # vector, block, symbol in front
        added = (added[:, :, None] + more).transpose(0, 2, 1).reshape(len(vectors), -1)
        step = nxt.transpose(0, 2, 1).reshape(len(vectors), -1)
    return Tables(vectors, one, step, added, 0, min(last))


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` with the faults that a hash of id and turn chooses: dropped, emptied, cut marks, repeated, or another role."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fault")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_again")).drop("_again")


_ORDERED = "part int, pos long, conv_id long, turn long, role string, text string, times long, symbols binary, stats array<long>, initials array<string>"


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order with their place in a segment. A segment's last row (its text null) holds the symbols and what is counted."""
    part = TaskContext.get().partitionId()
    schema = pa.schema([("part", pa.int32()), ("pos", pa.int64()), ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("times", pa.int64()), ("symbols", pa.binary()), ("stats", pa.list_(pa.int64())), ("initials", pa.list_(pa.string()))])

    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def segments() -> Iterator[tuple]:
        for conv, group in groupby(rows(), lambda r: r[0]):
            symbols, pos, first, prev = bytearray(), 0, None, None
            low = high = None
            blank = duplicate = truncated = illegal = turns = 0
            for _, turn, role, text, times, fault, seen in group:
                initial = role[:1]
                for k in range(times):
                    if first is None:
                        first = initial
                    elif prev + initial not in ("su", "ua", "au"):
                        illegal += 1
                    prev = initial
                    gone = fault == 1 or seen or k > 0
                    blank, duplicate, truncated = blank + (fault == 1), duplicate + (gone and fault != 1), truncated + (fault == 2 and not gone)
                    symbols.append(GONE if gone else (INITIALS.find(initial) % 4 if initial else 3) + (4 if fault == 2 else 0))
                if turn is not None:
                    turns += turn != high
                    low, high = turn if low is None else low, turn
                yield part, pos, conv, turn, role, text, times, None, None, None
                pos += times
            yield part, pos, conv, None, None, None, 0, bytes(symbols), [blank, duplicate, truncated, illegal, turns, low, high], [first, prev]

    held = []
    for r in segments():
        held.append(r)
        if len(held) == 4096:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)


def ordered(rows: DataFrame) -> DataFrame:
    """Rows of all conversations in order, each with its faults, and one row a segment; equal rows are one row with ``times``."""
    blank = F.when(~F.col("text").rlike(f"[^{_BLANK}]"), 1).when(~F.col("text").rlike(f"[.!?][{_BLANK}]*\\z"), 2).otherwise(0)
    key = F.sha2("text", 256)
    once = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", key.alias("digest")).groupBy("conv_id", "turn", "role", "digest").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
    once = materialize(once, workspace(rows.sparkSession, "repair"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = once.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialize(first, workspace(rows.sparkSession, "repair")).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    said = once.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    faults = said.select("conv_id", "turn", "role", "digest", "text", "times", blank.alias("fault"), F.coalesce(place > F.col("first"), F.lit(False)).alias("seen"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]  # no texts: ranges are drawn from samples of these
    return faults.repartitionByRange(*order).sortWithinPartitions(*order).drop("digest").mapInArrow(_ordered, _ORDERED)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the segments of whole conversations in order: counts and cost, and for each segment the vector behind it."""
    t = tables()
    for b in batches:
        out = []
        for conv, segments in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counts, prev, high, low, turns, behind, cost = [0] * 4, None, None, None, 0, [], t.end_cost
            for s in segments:
                blank, duplicate, truncated, illegal, n, lo, hi = s["stats"]
                head, tail = s["initials"]
                counts = [a + c for a, c in zip(counts, (blank, duplicate, truncated, illegal))]
                counts[3] += prev is not None and prev + head not in ("su", "ua", "au")
                prev = tail
                if lo is not None:
                    turns, low, high = turns + n - (lo == high), lo if low is None else low, hi
            v = t.end
            for s in reversed(segments):
                behind.append(v)
                cost += s["added"][v]
                v = s["to"][v]
            cost += t.vectors[v][0]
            gaps = 0 if low is None else high - low + 1 - turns
            out.append({"conv_id": conv, "gaps": gaps, "blank": counts[0], "duplicate": counts[1], "truncated": counts[2], "illegal": counts[3], "cost": cost, "segments": [{"part": s["part"], "behind": v, "last": k == len(segments) - 1} for k, (s, v) in enumerate(zip(segments, behind[::-1]))]})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("segments", pa.list_(pa.struct([("part", pa.int32()), ("behind", pa.int32()), ("last", pa.bool_())])))]))


def _through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = tables()
    for b in batches:
        to, added = zip(*(t.through(s.as_py()) for s in b.column("symbols"))) if b.num_rows else ((), ())
        rest = b.drop_columns(["symbols"])
        yield rest.append_column("to", pa.array(to, pa.list_(pa.int32()))).append_column("added", pa.array(added, pa.list_(pa.int64())))


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audits of a segment from every state that it can be entered in, and the states after them."""
    t = tables()
    for b in batches:
        audits, after = [], []
        for symbols, v, last, alone in zip(*(b.column(c).to_pylist() for c in ("symbols", "behind", "last", "alone"))):
            behind = t.behind(symbols, v)
            each = [t.trace(symbols, behind, s, last) for s in range(1 if alone else 4)]
            audits.append([a for a, _ in each])
            after.append([s for _, s in each])
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("part"), pa.array(audits, pa.list_(pa.string())), pa.array(after, pa.list_(pa.int32()))], names=["conv_id", "part", "audits", "after"])


def _edited(rows: bool):
    """Streams conversations: an audit for each segment in front of its rows. Gives the repaired turns, or each conversation's audit and digest."""
    kinds = [("conv_id", pa.int64()), ("n", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())] if rows else [("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]

    def turns(group: Iterator[tuple], audits: list[str]) -> Iterator[tuple[str, str, str]]:
        state, todo = 0, iter(())

        def write(edit: str, role: str, text: str) -> Iterator[tuple[str, str, str]]:
            nonlocal state
            if edit == "D":
                return
            initial = role[:1] if edit == "K" else NEXT[state]
            state = AFTER[state, initial]
            yield (role if edit == "K" else ROLES[initial]), ("" if edit == "I" else text), edit

        for _, _, _, role, text, times, choices, chosen in group:
            if choices is not None:
                for edit in todo:
                    yield from write(edit, "", "")
                audits.append(choices[chosen])
                todo = iter(audits[-1])
                continue
            for _ in range(times):
                for edit in todo:
                    yield from write(edit, role, text)
                    if edit != "I":
                        break
        for edit in todo:
            yield from write(edit, "", "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        def results() -> Iterator[tuple]:
            for conv, group in groupby(stream(), lambda r: r[0]):
                audits, digest, n = [], hashlib.sha256(), 0
                for n, (role, text, edit) in enumerate(turns(group, audits), 1):
                    if rows:
                        yield conv, n - 1, role, text, edit
                    else:
                        digest.update((("\n" if n > 1 else "") + f"{role}:{text}").encode())
                if not rows:
                    yield conv, "".join(audits), digest.hexdigest()

        held: list[tuple] = []
        for r in results():
            held.append(r)
            if len(held) == 2048:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*held), kinds)], names=[n for n, _ in kinds])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*held), kinds)], names=[n for n, _ in kinds])

    return work


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each segment is entered, following the segments of a conversation."""
    for b in batches:
        out = []
        for conv, segments in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            state = 0
            for s in segments:
                out.append({"conv_id": conv, "part": s["part"], "chosen": state})
                state = s["after"][state] if len(s["after"]) > 1 else 0
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("chosen", pa.int32())]))


def solve(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts and cost by conversation; rows in order, an audit in front of each segment) for the ``rows`` of conversations."""
    spark = rows.sparkSession
    placed = materialize(ordered(rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")), workspace(spark, "repair"))
    segments = placed.where("symbols IS NOT NULL").select("conv_id", "part", "symbols", "stats", "initials")
    listed = lambda df, *c: df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", *c))).alias("segments"))  # noqa: E731  # as many as there are ranges, at most
    effect = segments.mapInArrow(_through, "conv_id long, part int, stats array<long>, initials array<string>, to array<int>, added array<long>")
    counted = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    counts = materialize(listed(effect, "stats", "initials", "to", "added").mapInArrow(_linked, f"{counted}, segments array<struct<part: int, behind: int, last: boolean>>"), workspace(spark, "repair"))
    behind = counts.select(F.col("conv_id").alias("c"), F.explode("segments").alias("s"), (F.size("segments") == 1).alias("alone")).select("c", F.col("s.part").alias("p"), "s.behind", "s.last", "alone")
    meet = lambda a, b: F.col("conv_id").eqNullSafe(F.col(a)) & (F.col("part") == F.col(b))
    traced = segments.join(behind, meet("c", "p")).select("conv_id", "part", "symbols", "behind", "last", "alone").mapInArrow(_traced, "conv_id long, part int, audits array<string>, after array<int>")
    traced = materialize(traced, workspace(spark, "repair"))
    entered = listed(traced, "after").mapInArrow(_entered, "conv_id long, part int, chosen int").select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "chosen")
    heads = traced.join(entered, meet("c", "p")).select("conv_id", "part", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("times"), "audits", "chosen")
    body = placed.where("symbols IS NULL").select("conv_id", "part", "pos", "role", "text", "times", F.lit(None).cast("array<string>").alias("audits"), F.lit(None).cast("int").alias("chosen"))
    stream = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos")
    return counts.drop("segments"), stream


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, n (from 0), role, text and edit (K, R or I) of all turns after the cheapest repair."""
    return solve(rows)[1].mapInArrow(_edited(True), "conv_id long, n long, role string, text string, edit string")


def audit(rows: DataFrame) -> DataFrame:
    """Counts of faults, cost, audit and digest of the repaired text for each conversation."""
    counts, stream = solve(rows)
    said = stream.mapInArrow(_edited(False), "conv_id long, audit string, repaired_sha256 string").withColumnRenamed("conv_id", "c")
    return counts.join(said, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """``audit`` of ``damage``d conversations, with a row for each original one."""
    found = audit(damage(conversations)).withColumnRenamed("conv_id", "c")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
