"""Byte-level BPE encoding and decoding with overlapping chunks.

A text is cut into chunks that overlap. Each chunk is pre-tokenised on its own, so the chunks of
a very long text run in parallel. A chunk begins at an arbitrary place, perhaps inside a
pre-token, so its first pre-tokens may be wrong; but as the pattern never looks back, two chunks
agree for good from the first boundary they share in their overlap on. There they are stitched.
If an overlap holds no shared boundary (one run of letters may be longer), the next chunk is
pre-tokenised again from the last sure boundary. Pieces are then encoded by the ranks, each on
its own, and decoding concatenates the bytes of the ids.

Defined cases: a null or empty text has no tokens, and its digests are those of no bytes;
repeated rows each give a row; an empty table gives an empty result; columns beyond doc_id and
text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm._arrays import releasing
from siftwork.llm._common import unroll

#: Characters of a chunk, and of the part it shares with the next one.
CHUNK, OVERLAP = 1 << 16, 512
#: Characters before a chunk's end in which its boundaries aren't sure: more than the pattern looks ahead.
MARGIN = 8
#: Pieces whose ids are remembered in a worker.
REMEMBERED = 100_000
ROWS = 128


class Pieces(dict):
    """piece -> (number of ids, ids, decimal ids joined by a space, bytes that the ids decode to)."""

    def __init__(self, vocabulary: str, pattern: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.raw = {i: b for b, i in ranks.items()}
        self._merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def __missing__(self, piece: str):
        ids = self._merge(piece)
        self[piece] = out = (len(ids), tuple(ids), " ".join(map(str, ids)), b"".join(self.raw[i] for i in ids))
        return out

    def forget(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()


@lru_cache(maxsize=2)
def codec(vocabulary: str, pattern: str) -> Pieces:
    return Pieces(vocabulary, pattern)


@dataclass
class Chunk:
    """Part of a text: its start, its characters, and the ends of its pre-tokens, counted from the text's start."""

    start: int
    text: str
    last: bool
    pieces: list[str] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)

    def tokenise(self, pattern: regex.Pattern) -> Chunk:
        self.pieces, self.ends, at = pattern.findall(self.text), [], self.start
        for p in self.pieces:
            at += len(p)
            self.ends.append(at)
        return self

    @property
    def sure(self) -> int:
        """Number of pieces whose ends can't be changed by what follows the chunk."""
        return len(self.ends) if self.last else bisect_left(self.ends, self.start + len(self.text) - MARGIN)


def chunks(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[Chunk]:
    for start in range(0, max(len(text), 1), chunk):
        if start and start >= len(text):
            break
        end = start + chunk + overlap
        yield Chunk(start, text[start:end], end >= len(text))
        if end >= len(text):
            break


def stitch(parts: Iterable[Chunk], pattern: regex.Pattern) -> Iterator[list[str]]:
    """Lists of the whole text's pre-tokens in order. Two chunks are held at a time."""
    now, begin = None, 0
    for nxt in parts:
        if now is None:
            now, begin = nxt, 0
            continue
        sure = now.sure
        own = {nxt.start: 0} | {e: k + 1 for k, e in enumerate(nxt.ends[: nxt.sure])}
        shared = next((k for k in range(bisect_left(now.ends, nxt.start, begin), sure) if now.ends[k] in own), None)
        if begin == 0 and now.start == nxt.start:
            shared = None
        if shared is not None:
            yield now.pieces[begin : shared + 1]
            now, begin = nxt, own[now.ends[shared]]
            continue
        yield now.pieces[begin:sure]
        at = now.ends[sure - 1] if sure > begin else (now.ends[begin - 1] if begin else now.start)
        rest = now.text[at - now.start :]
        rest += nxt.text[now.start + len(now.text) - nxt.start :]
        now, begin = Chunk(at, rest, nxt.last).tokenise(pattern), 0
    if now is not None:
        yield now.pieces[begin:]


class Digest:
    """Grows with the pieces of one text."""

    def __init__(self) -> None:
        self.n, self.ids, self.raw, self.all = 0, hashlib.sha256(), hashlib.sha256(), []

    def add(self, pieces: list[str], known: Pieces, keep: bool) -> None:
        got = [known[p] for p in pieces]
        if not got:
            return
        self.ids.update(((" " if self.n else "") + " ".join([g[2] for g in got])).encode())
        self.raw.update(b"".join([g[3] for g in got]))
        self.n += sum([g[0] for g in got])
        if keep:
            for g in got:
                self.all.extend(g[1])
        known.forget()

    def row(self, keep: bool) -> tuple:
        return (self.n, self.ids.hexdigest(), self.raw.hexdigest()) + ((self.all,) if keep else ())


#: A chunk of a long text on its way.
CUT = pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("n", pa.int32()), ("start", pa.int64()), ("text", pa.string()), ("last", pa.bool_())])


def _schema(keep: bool) -> str:
    return "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep


def _batch(rows: list[tuple], keep: bool) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * keep
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def encode(docs: DataFrame, vocabulary: str, pattern: str, ids: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes, and with ``ids`` the ids, for every document.

    ``vocabulary`` is a file of ranks that all executors can read.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(vocabulary, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part, rows = batch.slice(k, ROWS), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    d = Digest()
                    for pieces in stitch((c.tokenise(known.pattern) for c in chunks(text or "", chunk, overlap)), known.pattern):
                        d.add(pieces, known, ids)
                    rows.append((doc_id, *d.row(ids)))
                yield _batch(rows, ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_id, text, row = (batch.column(j)[k].as_py() for j in range(3))
                for n, c in enumerate(chunks(text, chunk, overlap)):
                    one = {"row": [row], "doc_id": [doc_id], "n": [n], "start": [c.start], "text": [c.text], "last": [c.last]}
                    yield pa.RecordBatch.from_pydict(one, schema=CUT)

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(vocabulary, pattern)
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                ends = Chunk(one.column(3)[0].as_py(), one.column(4)[0].as_py(), one.column(5)[0].as_py()).tokenise(known.pattern).ends
                yield one.append_column("ends", pa.array([ends], pa.list_(pa.int64())))

    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, state = codec(vocabulary, pattern), {}

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for k in range(batch.num_rows):
                    yield tuple(c[k].as_py() for c in batch.columns)

        def texts() -> Iterator[tuple[int | None, Iterator[Chunk]]]:
            stream = rows()
            head = next(stream, None)
            while head is not None:
                state["next"], row = head, head[0]

                def of(row: str = row) -> Iterator[Chunk]:
                    while state["next"] is not None and state["next"][0] == row:
                        _, _, _, start, text, last, ends = state["next"]
                        cuts = [0, *[e - start for e in ends]]
                        state["next"] = next(stream, None)
                        yield Chunk(start, text, last, [text[a:b] for a, b in zip(cuts, cuts[1:])], ends)

                yield head[1], of()
                head = state["next"]

        for doc_id, parts in texts():
            d = Digest()
            for pieces in stitch(parts, known.pattern):
                d.add(pieces, known, ids)
            yield _batch([(doc_id, *d.row(ids))], ids)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long_text = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = docs.where(~long_text).mapInArrow(releasing(whole), _schema(ids))
    # a long text is known by its contents and its ordinal among equal rows, wherever it lies: a lost task cuts it alike
    long_rows = docs.where(long_text).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("times"))
    parts = unroll(long_rows, "times", "nth").select("doc_id", "text", F.md5(F.to_json(F.struct("doc_id", F.sha2("text", 256).alias("text"), "nth"))).alias("row"))
    kinds = "row string, doc_id long, n int, start long, text string, last boolean"
    parts = parts.mapInArrow(cut, kinds).repartition("row", "n").mapInArrow(tokenised, f"{kinds}, ends array<long>")
    return short.unionByName(parts.repartition("row").sortWithinPartitions("row", "n").mapInArrow(stitched, _schema(ids)))


def decode(tokens: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and the text of ``tokens`` (doc_id, ids): the bytes of the ids in order, read as UTF-8."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = codec(vocabulary, pattern).raw
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                out = [b"".join([raw[i] for i in x or ()]).decode("utf-8", "replace") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(texts, "doc_id long, text string")
