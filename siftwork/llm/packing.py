"""Packing of documents into sequences of fixed length by minimum bin slack.

A document is its token ids and one id that ends it. Its first pieces are whole windows; only what
is left over has to be combined. A histogram of the lengths left over has at most ``window``
entries, however large the table, so the combinations are planned on it alone:

1. The longest length left seeds a window. A bitset of the sums that the other lengths can make
   (multiplicities by halves, 1, 2, 4, ...) is grown until it holds the room that is left or no
   length remains; the largest sum is traced back to counts by length.
2. This multiset fills as many windows as the counts allow. If it leaves a slack, one more
   document in each of these windows is cut to fill it, and its rest is a length as any other.
3. What is left when no window can be filled is dealt to sequences of powers of two, which need
   no padding.

The plan names documents by their rank among those of equal length, in intervals, so it has as
many entries as there are patterns, not documents. Each pattern leaves some length with fewer
than the pattern takes, so their number depends on ``window`` only.

Ranks are ordinals within (length, bucket) plus the counts of the buckets before; buckets are
hashes of the row, so a length that a third of all documents share is split among tasks.

Defined cases: a null or empty text is the ending id alone; repeated rows are packed each; a null
id is kept; an empty table gives no piece; columns beyond doc_id and text are ignored. A text is
cut at ASCII white space for the tokenizer, which drops white space: the ids are those of the
whole text. A single word of any length is encoded as a whole.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm._arrays import releasing, slices
from siftwork.llm._common import materialize, workspace

WINDOW, END = 4096, 2
#: Pieces of one length for each bucket, and the most buckets.
BUCKET, MOST_BUCKETS = 1_000, 1 << 16
#: Bytes of text that are tokenised at once; words remembered in a worker, and their greatest length.
SLICE, REMEMBERED, SHORT = 4 << 20, 800_000, 32
#: Fixed value: lower-case letters that no normalisation changes.
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
#: A rank's bits in the key of a plan's entry; the length is above them.
RANK_BITS = 48


class Words:
    """Ids of words as the tokenizer gives them. Those of short words are remembered, behind one another in one array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # words of plain letters are one pre-token as they stand
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # letters that become a letter and a mark, which joins the punctuation behind it
        letters = (c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c)[0] == "L")
        self.end = r"([^\P{L}" + "".join(c for c in letters if unicodedata.category(unicodedata.normalize("NFC", c).lower()[-1])[0] != "L") + "])([.,;:!?])"
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def _append(self, at: int, encoded: list[list[int]]) -> None:
        """Puts the ids of further words behind slot ``at`` - 1, in arrays that double."""
        ends = (self.ends[at - 1] if at else 0) + np.cumsum([len(e) for e in encoded])
        flat = np.array([i for e in encoded for i in e], np.uint32)
        for name, size in (("ids", int(ends[-1])), ("ends", at + len(ends))):
            held = getattr(self, name)
            if size > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(size, 2 * len(held)) - len(held), held.dtype)]))
        self.ids[int(ends[-1]) - len(flat) : int(ends[-1])] = flat
        self.ends[at : at + len(ends)] = ends

    def _encode(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(words)
        plain = [PLAIN(w) is not None for w in words]
        for tokenizer, some in ((self.plain, True), (self.tokenizer, False)):
            at = [k for k, p in enumerate(plain) if p is some]
            for k, e in zip(at, tokenizer.encode_batch_fast([words[k] for k in at], add_special_tokens=False)):
                out[k] = e.ids
        return out

    def find(self, words: list[str]) -> np.ndarray:
        """Slots of distinct words. Those of long words hold until the next call."""
        if len(self.slots) + len(words) > REMEMBERED:
            self.forget()
        found = list(map(self.slots.get, words))
        new = [k for k, slot in enumerate(found) if slot is None]
        if new:
            new.sort(key=lambda k: len(words[k]) > SHORT)
            at = len(self.slots)
            self._append(at, self._encode([words[k] for k in new]))
            for slot, k in enumerate(new, at):
                found[k] = slot
            self.slots.update((words[k], found[k]) for k in new if len(words[k]) <= SHORT)
        return np.array(found, np.int64)

    def texts(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``end``; number of ids by text)."""
        texts = pc.fill_null(texts, "")
        if not pc.any(pc.match_substring_regex(texts, r"\p{M}")).as_py():
            # without marks to compose, case can be folded before, and a letter ends a token before punctuation: fewer words
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), self.end, r"\1 \2")
        split = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(split.flatten())
        slots = self.find(coded.dictionary.to_pylist())
        n = int(slots.max(initial=-1)) + 1
        starts = np.concatenate([[0], self.ends[: max(n - 1, 0)]])[slots] if len(slots) else slots
        sizes = np.append(self.ends[slots] - starts, 1)
        starts = np.append(starts, self.ends[n - 1] if n else 0)
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        order = np.insert(coded.indices.to_numpy(zero_copy_only=False), bounds[1:], len(slots))
        lengths = sizes.astype(np.int32)[order]
        ends = np.cumsum(lengths, dtype=np.int64)
        at = np.repeat((starts[order] - (ends - lengths)).astype(np.int32), lengths) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
        of_text = ends[bounds[1:] + np.arange(len(bounds) - 1)]
        ids = np.append(self.ids[: self.ends[n - 1] if n else 0], np.uint32(end))
        return ids[at], np.diff(of_text, prepend=0)


@lru_cache(maxsize=1)
def words_of(path: str) -> Words:
    return Words(path)


@dataclass
class Plan:
    """Where the documents of each length go: entries in the order of ``key`` (length and first rank).

    Of a length's documents from rank ``first`` on, ``each`` go to every one of the windows from
    ``sequence`` on, at ``offset`` and behind one another. With ``cut`` only so many of its ids do; the
    rest is the document of rank ``rest`` (and following) among those of its length.
    """

    key: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    cut: np.ndarray
    rest: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, ids of the row before it, length, sequence, offset) of each piece."""
        row, start, out = np.arange(len(length)), np.zeros(len(length), np.int64), []
        while len(row):
            e = np.searchsorted(self.key, (length << RANK_BITS) | rank, "right") - 1
            nth = rank - self.first[e]
            cut = self.cut[e]
            out.append((row, start, np.where(cut > 0, cut, length), self.sequence[e] + nth // self.each[e], self.offset[e] + nth % self.each[e] * length))
            more = cut > 0
            row, start, length, rank = row[more], (start + cut)[more], (length - cut)[more], (self.rest[e] + nth)[more]
        return tuple(np.concatenate(c) for c in zip(*out))


def fill(counts: dict[int, int], room: int) -> Counter:
    """Lengths, with how many of each, whose sum is the largest up to ``room``: a bitset of sums, traced back."""
    reach, steps = 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, many = min(counts[length], room // length), 1
        while left:
            take = min(many, left)
            steps.append((length, take, reach))
            reach |= (reach << length * take) & ((2 << room) - 1)
            left, many = left - take, many * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] += take
            total -= length * take
    return used


def plan(histogram: dict[int, int], window: int = WINDOW) -> Plan:
    """The plan for so many documents of each length, none longer than ``window``."""
    counts, last = dict(histogram), dict(histogram)
    entries: list[tuple[int, ...]] = []
    sequence = 0

    def put(length: int, each: int, windows: int, offset: int, cut: int = 0) -> None:
        first, rest = last[length] - counts[length], 0
        counts[length] -= each * windows
        if cut:
            rest = last.get(length - cut, 0)
            last[length - cut] = rest + windows
            counts[length - cut] = counts.get(length - cut, 0) + windows
        entries.append(((length << RANK_BITS) | first, first, each, sequence, offset, cut, rest))

    left = sum(x * n for x, n in counts.items())
    while left >= window:
        longest = max(x for x, n in counts.items() if n)
        used = Counter([longest])
        used += fill({x: n - (x == longest) for x, n in counts.items()}, window - longest)
        slack, cut = window - sum(x * n for x, n in used.items()), 0
        need = Counter(used)
        if slack:
            cut = max(x for x, n in counts.items() if n > used[x])
            need[cut] += 1
        windows, offset = min(counts[x] // n for x, n in need.items()), 0
        for x, n in sorted(used.items(), reverse=True):
            put(x, n, windows, offset)
            offset += x * n
        if slack:
            put(cut, 1, windows, offset, slack)
        sequence, left = sequence + windows, left - windows * window
    room = offset = 0
    while left:
        if not room:
            room, offset = 1 << (left.bit_length() - 1), 0
        x = max(x for x, n in counts.items() if n)
        cut = 0 if x <= room else room
        put(x, 1, 1, offset, cut)
        taken = cut or x
        room, left, offset = room - taken, left - taken, offset + taken
        sequence += not room
    return Plan(*np.array(sorted(entries), np.int64).reshape(-1, 7).T)


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """doc_id, start, length, ids (32 bits each, little-endian) and doc_tokens of the documents, cut into whole windows and a rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words_of(tokenizer)
        for part in (s for b in batches for s in slices(b, 1, SLICE)):
            ids, lengths = known.texts(part.column(1), end)
            times = -(-lengths // window)
            row, raw = np.repeat(np.arange(len(lengths)), times), ids.astype("<u4").tobytes()
            start = (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)) * window
            size = np.minimum(lengths[row] - start, window)
            stops = np.cumsum(size) * 4
            cuts = pa.array([raw[b - n * 4 : b] for b, n in zip(stops.tolist(), size.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(start), pa.array(size), cuts, pa.array(lengths[row])], names=["doc_id", "start", "length", "ids", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(cut), "doc_id long, start long, length long, ids binary, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """The pieces of all documents with their place: ``sequence_id`` (gapless from 0) and ``offset`` in it.

    ``tokenizer`` is a file that all executors can read.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, window, end), workspace(spark, "packing"))
    n = cut.count()
    buckets = min(max(n // BUCKET, 1), MOST_BUCKETS)
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", F.crc32("ids")), F.lit(buckets)))
    sizes = materialize(keyed.groupBy("length", "bucket").count(), workspace(spark, "packing"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # one row a length, ``window`` at most
    where = plan(histogram, window)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", F.crc32("ids"), "doc_tokens", "ids"))
    ranked = keyed.join(firsts, ["length", "bucket"]).select("doc_id", "start", "length", "ids", "doc_tokens", (F.col("before") + nth - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            doc_id, start, length, ids, tokens, rank = b.columns
            row, skipped, size, sequence, offset = where.place(length.to_numpy(), rank.to_numpy())
            at = pa.array(row)
            raw = ids.to_pylist()
            parts = pa.array([raw[r] if not s and n * 4 == len(raw[r]) else raw[r][s * 4 : (s + n) * 4] for r, s, n in zip(row.tolist(), skipped.tolist(), size.tolist())], pa.binary())
            columns = [doc_id.take(at), pa.array(start.to_numpy()[row] + skipped), pa.array(size), parts, tokens.take(at), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(releasing(place), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids of each whole sequence: its pieces behind one another, ``WINDOW`` ids at most."""
    held = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.aggregate(held, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
