"""Language-model scoring with a log-frequency Bloom filter.

Counts of pairs and triples of words are gathered from the training documents and kept in Bloom
filters by their level, on a scale that is exact up to ``EXACT`` and grows by ``RATIO`` from there: a
gram is entered once for each level up to its own. To look a gram up, its levels are probed one
after the other until one is missing; the mean of the last level's counts is the gram's. A filter
never forgets, so a count is rarely too high and never too low by more than its level.

Grams are dealt by hash to segments. A segment is built by one task from the sums of the map
tasks, merged as they come, and written to the shared folder, from where the workers fetch it: this
is the broadcast, and it does not pass through the driver. To score, documents are dealt to slices
of some MB. A slice asks for each of its distinct grams once; the questions are shuffled to the
segments, a worker fetches each segment once and answers all questions to it by membership
probes, and the answers are shuffled back to their slices. A worker holds a segment and a slice.
There is a row for each slice and segment that it asks, so with many segments a row holds few
grams, in the end one: an exchange of some 50 bytes a gram instead of 4 at 30 GB. And the driver
holds a file name a segment. Both bound this form to a few TB. The exact counts of words, which the
base score needs, are kept in the segments too, as sorted arrays of 64-bit hashes.

The model is a trigram model with Dirichlet priors: p(w | u v) = (c(u v w) + B3 p(w | v)) / (c(u v) + B3),
p(w | v) = (c(v w) + B2 p(w)) / (c(v) + B2), and p(w) is smoothed as in the base score, with a share for
one unseen word. It sums to 1 over the vocabulary and the unseen word, up to the levels' rounding: the
counts of what follows a context, each off by a factor of ``RATIO ** 0.5`` at most above ``EXACT``, no
longer add to the context's own. So the sum is within ``RATIO - 1`` of 1, apart from filter errors.
At the start of a text, and after a context that is unseen, the shorter context counts alone.

Words are runs outside ASCII white space with A-Z lowered; an end follows the last. Defined
cases: a null or empty text is the end alone; a null id counts as the empty text for the
division; repeated rows are counted and scored each; without training documents all words are
unknown; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm._arrays import hashes, mix, release, releasing, slices, word_hashes
from siftwork.llm._common import materialize, open_fs, workspace

#: Bits of the filter for each entry, probes for each entry; the scale of counts.
BITS, PROBES, EXACT, RATIO, LEVELS = 10, 5, 4, 1.25, 120
#: Words of the longest grams, and the weights of the priors of pairs and triples.
ORDER, PRIORS = 3, {2: 200.0, 3: 4.0}
#: Grams of a segment at most, on average; sums that a map task holds before it passes them on; bytes of text that are counted at once, and of a slice.
SEGMENT_GRAMS, HELD, TEXT, SLICE = 1 << 20, 1 << 22, 4 << 20, 12 << 20
ALPHA = 0.1
#: The end's hash input holds a space, so no word is equal to it.
END = " </s>"
#: Bytes of a word's hash within its segment, and of its count in answers.
WIDE = 6
#: Kinds of what is counted; grams of more words have their number.
WORDS = 1


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens with each text's end, number of tokens by text)."""
    h, sizes = word_hashes(texts, lower=True)
    out = np.empty(len(h) + len(sizes), np.uint64)
    ends = np.cumsum(sizes + 1) - 1
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep], out[ends] = h, hashes([END])[0]
    return out, sizes + 1


def grams(h: np.ndarray, sizes: np.ndarray, order: int = ORDER) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of words from 2 on: (hash of the gram that ends at each token, which tokens have one)."""
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at, out, now = np.arange(len(h)) - starts, {}, h
    for n in range(2, order + 1):
        with np.errstate(over="ignore"):
            now = mix(np.concatenate([now[:1], now[:-1]]) * np.uint64(3) + mix(h, 9 + n), 3 + n)
        out[n] = (now, at >= n - 1)
    return out


def held_out(ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in ids.to_pylist()], bool)


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    """Segment by the hash's upper half: consecutive ranges of hashes, so sorted hashes have sorted segments."""
    return ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def packed(kind: int, h: np.ndarray) -> bytes:
    """Hashes as they travel to their segment, which the upper bits tell: six bytes for words, which are counted exactly, the lower half for grams."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDE].tobytes() if kind == WORDS else h.astype("<u8").view("<u4")[::2].tobytes()


def unpacked(kind: int, raw: bytes) -> np.ndarray:
    return _widened(np.frombuffer(raw, np.uint8).reshape(-1, WIDE)) if kind == WORDS else np.frombuffer(raw, "<u4").astype(np.uint64)


def _widened(low: np.ndarray) -> np.ndarray:
    """Numbers from their ``WIDE`` low bytes."""
    return np.ascontiguousarray(np.pad(low, ((0, 0), (0, 8 - WIDE)))).view("<u8")[:, 0]


def told(kind: int, found: np.ndarray) -> bytes:
    """Answers as they travel back: a byte for a level; counts byte by byte, lowest bytes first, so the many zeros lie together."""
    return found.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDE].T.tobytes() if kind == WORDS else found.astype(np.uint8).tobytes()


def heard(kind: int, raw: bytes) -> np.ndarray:
    """Counts of words and levels of grams, as numbers."""
    return _widened(np.frombuffer(raw, np.uint8).reshape(WIDE, -1).T) if kind == WORDS else np.frombuffer(raw, np.uint8)


def by_segment(h: np.ndarray, segments: int) -> Iterator[tuple[int, np.ndarray]]:
    """(segment, its part) of sorted hashes, for segments that have any."""
    at = segment_of(h, segments)
    cuts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(h)]]) if len(h) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(at[a]), np.arange(a, b)


def _sum(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    if not len(h):
        return h, c
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(c, first)


class Sums:
    """Counts by hash that are merged whenever what came since outweighs what there is."""

    def __init__(self):
        self.h, self.c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new, self.size = [], 0

    def add(self, h: np.ndarray, c: np.ndarray) -> None:
        self.new.append((h, c))
        self.size += len(h)
        if self.size > len(self.h) + 65_536:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.new:
            self.h, self.c = _sum(np.concatenate([self.h, *[h for h, _ in self.new]]), np.concatenate([self.c, *[c for _, c in self.new]]))
            self.new, self.size = [], 0
        return self.h, self.c


PART = pa.schema([("kind", pa.int32()), ("segment", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])


def count(docs: DataFrame, segments: int, order: int = ORDER) -> DataFrame:
    """Partial sums of the counts of words and grams: rows by map flush, kind and segment, with packed arrays; without counts for what occurred once."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {kind: [] for kind in range(WORDS, order + 1)}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if not parts:
                    continue
                h, c = _sum(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                parts.clear()
                rows = []
                for segment, own in by_segment(h, segments):
                    n = c[own]
                    one, more = own[n == 1], own[n > 1]
                    if len(one):  # most grams; they travel without a count
                        rows.append((kind, segment, packed(kind, h[one]), b""))
                    if len(more):
                        most = n.max()
                        rows.append((kind, segment, packed(kind, h[more]), c[more].astype("<u1" if most < 1 << 8 else "<u4" if most < 1 << 32 else "<u8").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(PART)], schema=PART)

        for batch in batches:
            for part in slices(batch, 1, TEXT):
                part = part.filter(pa.array(~held_out(part.column(0))))
                h, sizes = tokens(part.column(1))
                for kind, x in [(WORDS, h)] + [(n, g[there]) for n, (g, there) in grams(h, sizes, order).items()]:
                    got = np.unique(x, return_counts=True)
                    if len(got[0]):
                        held[kind].append(got)
                        size += len(got[0])
                if size >= HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.mapInArrow(releasing(partial), "kind int, segment long, hashes binary, counts binary")


def _edges() -> np.ndarray:
    """Least count of each level from 1 on."""
    out = list(range(1, EXACT + 1))
    while len(out) < LEVELS:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * RATIO))))
    return np.array(out, np.float64)


EDGES = _edges()
#: Count that a level stands for: the mean of its own. Level 0 is none.
MEANS = np.concatenate([[0.0], (EDGES[:-1] + EDGES[1:] - 1) / 2, EDGES[-1:]])


def levels(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(EDGES, counts, side="right")


class Filter:
    """Log-frequency Bloom filter over the grams of a segment."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, np.uint64(size)

    @staticmethod
    def build(h: np.ndarray, counts: np.ndarray) -> Filter:
        top = levels(counts)
        size = max(64, int(top.sum()) * BITS)
        size += -size % 8
        out = Filter(np.zeros(size // 8, np.uint8), size)
        order = np.argsort(-top, kind="stable")
        left, sorted_top = h[order], top[order]
        for level in range(1, int(top.max(initial=0)) + 1):
            left = left[: np.searchsorted(-sorted_top, -level, side="right")]
            for at in out._places(left, level):
                np.bitwise_or.at(out.bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        return out

    def _places(self, h: np.ndarray, level: int) -> Iterator[np.ndarray]:
        """Double hashing: probes of a level step on by an odd stride."""
        a, b = mix(h, 2 * level + 1), mix(h, 2 * level + 2) | np.uint64(1)
        for probe in range(PROBES):
            with np.errstate(over="ignore"):
                yield (a + np.uint64(probe) * b) % self.size

    def look(self, h: np.ndarray) -> np.ndarray:
        """Level of each gram, 0 if it isn't there."""
        found = np.zeros(len(h), np.int64)
        open_, level = np.arange(len(h)), 1
        while len(open_) and level <= LEVELS:
            left = h[open_]
            a, b = mix(left, 2 * level + 1), mix(left, 2 * level + 2) | np.uint64(1)
            for p in range(PROBES):
                with np.errstate(over="ignore"):
                    at = (a + np.uint64(p) * b) % self.size
                hit = (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                open_, a, b = open_[hit], a[hit], b[hit]
                if not len(open_):
                    break
            found[open_] = level
            level += 1
        return found


def _by_segment(rows: DataFrame, segments: int) -> DataFrame:
    """``rows`` dealt by segment, a few segments to a task at any size."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), segments // 8 + 1)
    return rows.repartition(tasks, "segment")


def build(parts: DataFrame, path: str, segments: int, order: int = ORDER) -> DataFrame:
    """Writes each segment's exact words and filters below ``path``; returns segment, file, words and tokens."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(path)
        fs.create_dir(root, recursive=True)
        now, held = None, {}

        def done() -> pa.RecordBatch:
            wh, wc = held.pop(WORDS, Sums()).merge()
            filters = [Filter.build(*held.pop(n, Sums()).merge()) for n in range(2, order + 1)]
            # a name that no other attempt uses; the manifest, which Spark commits, tells which one counts
            name = f"{now}-{uuid.uuid4().hex}.seg"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(struct.pack(f"<{2 + 2 * len(filters)}q", len(wh), len(filters), *[x for g in filters for x in (len(g.bits), int(g.size))]))
                f.write(packed(WORDS, wh) + packed(WORDS, wc.astype(np.uint64)))
                for g in filters:
                    f.write(g.bits.tobytes())
            return pa.RecordBatch.from_pydict({"segment": [now], "file": [name], "words": [len(wh)], "tokens": [int(wc.sum())]})

        for batch in batches:
            for kind, segment, h, c in zip(*(x for x in batch.columns)):
                if segment.as_py() != now and now is not None:
                    yield done()
                    held.clear()
                now, kind, c = segment.as_py(), kind.as_py(), c.as_py()
                h = unpacked(kind, h.as_py())
                counts = np.frombuffer(c, f"<u{len(c) // len(h)}").astype(np.int64) if c else np.ones(len(h), np.int64)
                held.setdefault(kind, Sums()).add(h, counts)
        if now is not None:
            yield done()

    dealt = _by_segment(parts, segments).sortWithinPartitions("segment")
    return materialize(dealt.mapInArrow(releasing(built), "segment long, file string, words long, tokens long"), f"{path}/manifest")


class Segment:
    def __init__(self, path: str, name: str):
        fs, root = open_fs(path)
        with fs.open_input_file(f"{root}/{name}") as f:
            raw = f.read()
        words, n = struct.unpack("<2q", raw[:16])
        sizes = struct.unpack(f"<{2 * n}q", raw[16 : 16 + 16 * n])
        at = 16 + 16 * n
        self.words = unpacked(WORDS, raw[at : at + WIDE * words])
        self.counts = unpacked(WORDS, raw[at + WIDE * words : at + 2 * WIDE * words]).astype(np.int64)
        at += 2 * WIDE * words
        self.filters = {}
        for k in range(n):
            self.filters[2 + k] = Filter(np.frombuffer(raw, np.uint8, sizes[2 * k], at), sizes[2 * k + 1])
            at += sizes[2 * k]

    def answer(self, kind: int, h: np.ndarray) -> np.ndarray:
        """Exact counts of words, levels of grams."""
        if kind != WORDS:
            return self.filters[kind].look(h)
        if not len(self.words):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.counts[at], 0)


def distinct(texts: pa.Array, order: int) -> tuple[np.ndarray, dict[int, tuple]]:
    """(tokens by text; by kind: distinct hashes in order, each token's place among them, which tokens count)."""
    h, sizes = tokens(texts)
    out = {WORDS: (*np.unique(h, return_inverse=True), np.ones(len(h), bool))}
    for n, (g, there) in grams(h, sizes, order).items():
        out[n] = (*np.unique(g[there], return_inverse=True), there)
    return sizes, out


def interpolate(p: np.ndarray, counts: np.ndarray, context: np.ndarray, prior: float) -> np.ndarray:
    """Probabilities in longer contexts from those in shorter ones, ``p``; a context that was never seen leaves them as they are."""
    return np.where(context > 0, (np.minimum(counts, context) + prior * p) / (context + prior), p)


QUESTION = pa.schema([("slice", pa.int64()), ("kind", pa.int32()), ("segment", pa.int64()), ("hashes", pa.binary())])
ANSWER = pa.schema([("slice", pa.int64()), ("kind", pa.int32()), ("segment", pa.int64()), ("found", pa.binary())])


def ask(sliced: DataFrame, segments: int, order: int) -> DataFrame:
    """The questions of all slices: a row for each slice, kind and segment."""

    def asked(table: pa.Table) -> pa.Table:
        _, kinds = distinct(pa.concat_arrays(table.column("text").chunks), order)
        at = table.column("slice")[0].as_py()
        rows = [(at, kind, segment, packed(kind, u[own])) for kind, (u, _, _) in kinds.items() for segment, own in by_segment(u, segments)]
        release()
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(QUESTION)], schema=QUESTION)

    return sliced.groupBy("slice").applyInArrow(asked, "slice long, kind int, segment long, hashes binary")


def answer(questions: DataFrame, path: str, segments: int, present: dict[int, str]) -> DataFrame:
    """The questions with ``found`` in place of the hashes: a worker fetches a segment and answers all questions to it."""

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, segment = None, None
        for batch in batches:
            kinds, at = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero((kinds[1:] != kinds[:-1]) | (at[1:] != at[:-1])) + 1).tolist(), len(at)]
            found: list[bytes] = []
            for a, b in zip(cuts[:-1], cuts[1:]):  # all questions of a kind to a segment at once
                kind, k = int(kinds[a]), int(at[a])
                if k != now:
                    now, segment = k, Segment(path, present[k]) if k in present else None
                asked = batch.column(3).slice(a, b - a).to_pylist()
                h = unpacked(kind, b"".join(asked))
                ends = np.cumsum([len(x) // (WIDE if kind == WORDS else 4) for x in asked]).tolist()
                known = segment.answer(kind, h) if segment else np.zeros(len(h), np.int64)
                found += [told(kind, known[x:y]) for x, y in zip([0, *ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], schema=ANSWER)

    dealt = _by_segment(questions, segments).sortWithinPartitions("segment", "kind")
    return dealt.mapInArrow(releasing(answered), "slice long, kind int, segment long, found binary")


def score(docs: DataFrame, segments: int | None = None, order: int = ORDER, slice_bytes: int = SLICE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    path = workspace(spark, "lm")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    if segments is None:  # about 6 bytes a token, and most grams of a text are its own
        segments = max(8, (order - 1) * size // (6 * SEGMENT_GRAMS) + 1)
    manifest = build(count(docs, segments, order), f"{path}/segments", segments, order)
    n, v = manifest.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    present = {r[0]: r[1] for r in manifest.select("segment", "file").collect()}  # one name a segment, not a gram
    base_all = n + ALPHA * (v + 1)
    # by contents, and the partition that a row lies in, so that rows repeated often are spread; a lost task deals its rows alike again
    n_slices = size // slice_bytes + 1
    place = F.pmod(F.xxhash64("doc_id", "text") + F.spark_partition_id(), F.lit(n_slices))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * n_slices)  # few slices by chance in one
    sliced = docs.withColumn("slice", place).repartition(parts, "slice")
    answers = answer(ask(sliced, segments, order), f"{path}/segments", segments, present)
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scored(texts: pa.Table, found: pa.Table) -> pa.Table:
        sizes, own = distinct(pa.concat_arrays(texts.column("text").chunks), order)
        starts = np.cumsum(sizes) - sizes
        parts: dict[int, list] = {}
        for kind, segment, raw in zip(found.column("kind").to_pylist(), found.column("segment").to_pylist(), found.column("found").to_pylist()):
            parts.setdefault(kind, []).append((segment, raw))
        values = {}
        for kind, (_, back, there) in own.items():
            raw = [heard(kind, x) for _, x in sorted(parts.get(kind, []))]
            known = np.concatenate(raw) if raw else np.zeros(0, np.uint8)
            known = known.astype(np.float64) if kind == WORDS else MEANS[known]
            values[kind] = np.zeros(len(there))
            values[kind][there] = known[back]
        exact = values[WORDS]
        p = (exact + ALPHA) / base_all
        base = np.log10(p)
        for k in range(2, order + 1):
            context = np.concatenate([[0.0], values[k - 1][:-1]]) * own[k][2]
            p = interpolate(p, values[k], context, PRIORS[k])
        ids = pa.concat_arrays(texts.column("doc_id").chunks)
        total = lambda x: np.add.reduceat(x, starts)
        columns = [ids, held_out(ids), sizes, total((exact > 0).astype(np.int64)), np.full(len(sizes), n, np.int64), total(base), total(np.log10(p))]
        release()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return sliced.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(scored, schema)
