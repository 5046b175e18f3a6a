"""Phrases whose words keep together, from weighted acyclic automata of n-gram counts.

1. Words are counted. A phrase that occurs ``LEAST`` times has only words that do, and only pairs
   of words that do, so pairs of frequent words are counted next (by 64-bit hashes: a collision
   can only let a pair through). Both sets are kept as bit filters of fixed size, the one thing
   that is broadcast; what passes wrongly is counted like the rest and ends below ``LEAST``.
2. Each shard, a slice of a task's texts, numbers its words in byte order and sorts its positions by the
   words that follow, as far as the pairs are frequent. The sorted phrases of two to five words
   with their counts become count transducers, one for each prefix range, built incrementally: as
   soon as a phrase leaves a state behind, that state is final, and an equal one (same weight and
   arcs) takes its place. A prefix range is a language and the shortest prefix of the first word
   with at most a ``RANGES``-th of all words; a word that is more frequent by itself is parted by
   the first byte of the second word. So ranges stay small however frequent a word is, and those
   that have to be split are few: these prefixes are broadcast.
3. The transducers of a range are united: their sorted phrases are merged, equal ones add their
   weights, and the sum is built anew. Ranges of many shards are united by groups of shards
   first. The words' own counts, known from step 1, join as one further transducer.
4. Candidates are the phrases of a united transducer with at least ``LEAST`` occurrences. Their
   parts are sent to the parts' ranges, made an acceptor there, and composed with the transducer:
   both are walked along the labels they share, and the final weights are the parts' counts.

Scores are integers of 38 digits. A candidate goes if a phrase one word longer is as frequent: a
frequency never rises with length, so any longer phrase as frequent has one of these between.

Defined cases: null texts are empty; null languages are ``und``; repeated rows count each time; an empty table, or
one without frequent phrases, gives an empty result; columns beyond text and lang are ignored;
ties in score and count are broken by the phrase.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.llm._arrays import hashes, mix, releasing, slices
from siftwork.llm._common import materialize, workspace

LEAST, LONGEST, TOP = 100, 5, 2000
#: Fixed value: characters that end a piece.
ENDS = r"[.,;:!?\n-\r]+"
#: Bytes of text of a shard; bits of a filter; transducers of a range that one task unites at once.
SHARD, BITS, UNITED = 12 << 20, 1 << 26, 64
#: Prefixes with more than this share of all words are split, up to a number of characters.
RANGES, PREFIX = 1_000, 8
#: Salts by which the candidates of one language are ranked first.
SALTS = 64
#: Bytes of the languages' totals that are broadcast at most.
BROADCAST_BYTES = 16 << 20
EMPTY = "und"
#: floor(1000 a n / (l r)) of counts below 10 ** 17, in decimals of 38 digits.
SCORE = "cast(a AS decimal(17,0)) * cast(n AS decimal(17,0)) * 1000BD div (cast(l AS decimal(17,0)) * cast(r AS decimal(17,0)))"


class Transducer:
    """Acyclic automaton over words: for each state a weight (0: no phrase ends here) and arcs in the order of their labels."""

    def __init__(self, weights: list[int], arcs: list[tuple[tuple[str, int], ...]], root: int):
        self.weights, self.arcs, self.root = weights, arcs, root

    @classmethod
    def of(cls, phrases: Iterable[tuple[tuple[str, ...], int]]) -> Transducer:
        """From distinct phrases in ascending order with their weights."""
        weights: list[int] = []
        arcs: list[tuple[tuple[str, int], ...]] = []
        known: dict[object, int] = {}
        ended, out = [0], [[]]  # weight and closed arcs of each state on the last phrase's path
        last: tuple[str, ...] = ()
        for phrase, weight in chain(phrases, [((), 0)]):  # the empty phrase closes all but the root
            same, most = 0, min(len(last), len(phrase))
            while same < most and last[same] == phrase[same]:
                same += 1
            for depth in range(len(last), same, -1):
                held, own = out.pop(), ended.pop()
                state = (own, *held) if held else own
                number = known.get(state)
                if number is None:
                    number = known[state] = len(weights)
                    weights.append(own)
                    arcs.append(tuple(held))
                out[-1].append((last[depth - 1], number))
            for _ in range(len(phrase) - same):
                ended.append(0)
                out.append([])
            if phrase:
                ended[-1], last = weight, phrase
        weights.append(0)
        arcs.append(tuple(out[0]))
        return cls(weights, arcs, len(weights) - 1)

    def phrases(self) -> Iterator[tuple[tuple[str, ...], int]]:
        """Phrases in ascending order with their weights."""
        stack = [((), self.root)]
        while stack:
            phrase, state = stack.pop()
            if self.weights[state]:
                yield phrase, self.weights[state]
            stack.extend((phrase + (label,), to) for label, to in reversed(self.arcs[state]))

    def composed(self, other: Transducer) -> Iterator[tuple[tuple[str, ...], int]]:
        """This transducer's weights of the phrases that ``other`` accepts."""
        stack = [((), self.root, other.root)]
        while stack:
            phrase, a, b = stack.pop()
            if self.weights[a] and other.weights[b]:
                yield phrase, self.weights[a]
            mine = dict(self.arcs[a])
            stack.extend((phrase + (label,), mine[label], to) for label, to in other.arcs[b] if label in mine)

    def row(self) -> dict[str, list]:
        """Columns of the stored form: weights, number of arcs by state, labels and targets. The root is the last state."""
        flat = [arc for arcs in self.arcs for arc in arcs]
        return {"weights": self.weights, "degrees": [len(a) for a in self.arcs], "labels": [x for x, _ in flat], "targets": [t for _, t in flat]}

    @classmethod
    def read(cls, weights: list[int], degrees: list[int], labels: list[str], targets: list[int]) -> Transducer:
        at, arcs = iter(zip(labels, targets)), []
        for n in degrees:
            arcs.append(tuple(next(at) for _ in range(n)))
        return cls(weights, arcs, len(weights) - 1)


def union(parts: Iterable[Transducer], least: int = 0) -> Transducer:
    """The sum of transducers; phrases below ``least`` go."""
    sums: dict[tuple[str, ...], int] = {}
    for t in parts:
        for phrase, weight in t.phrases():
            sums[phrase] = sums.get(phrase, 0) + weight
    return Transducer.of(sorted((p, w) for p, w in sums.items() if w >= least))


def _positions(part: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, list[str]]]:
    """(language, numbers of the words in order with -1 between pieces, words) of a slice of texts."""
    langs = pc.fill_null(part.column(1), EMPTY)
    for lang in pc.unique(langs).to_pylist():
        texts = pc.fill_null(part.column(0).filter(pc.equal(langs, lang)), "")
        # a mark that no word can hold stands between pieces, and texts
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.binary_join_element_wise(pc.ascii_lower(texts), ".", " "), ENDS, " . "))
        coded = pc.dictionary_encode(split.flatten())
        words = coded.dictionary.to_pylist()
        number = np.arange(len(words), dtype=np.int32)
        number[[k for k, w in enumerate(words) if w in (".", "")]] = -1
        if "" in words:  # white space at an end
            keep = pc.not_equal(split.flatten(), "").to_numpy(zero_copy_only=False)
            yield lang, number[coded.indices.to_numpy(zero_copy_only=False)[keep]], words
        else:
            yield lang, number[coded.indices.to_numpy(zero_copy_only=False)], words


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about ``SHARD`` bytes; longer texts are cut where a piece ends."""
    for part in (s for b in batches for s in slices(b, 0, SHARD)):
        if part.nbytes < 2 * SHARD:
            yield part
            continue
        for text, lang in zip(part.column(0), part.column(1).to_pylist()):
            text, at = text.as_py() or "", 0
            while at < len(text):
                end = re.compile(ENDS).search(text, at + SHARD)
                stop = end.start() if end else len(text)
                yield pa.RecordBatch.from_arrays([pa.array([text[at:stop]], pa.string()), pa.array([lang], pa.string())], names=["text", "lang"])
                at = stop


def _keys(lang: str, words: list[str]) -> np.ndarray:
    return hashes([f"{lang}\t{w}" for w in words])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of two neighbours' keys."""
    with np.errstate(over="ignore"):
        return mix(mix(a, 1) + b, 2)


def _held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the keys may be in a filter; two bits a key."""
    found = np.ones(len(keys), bool)
    for at in (keys & np.uint64(BITS - 1), (keys >> np.uint64(32)) & np.uint64(BITS - 1)):
        found &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def _filter(keys: DataFrame) -> np.ndarray:
    """Bit filter of ``key`` (long): as many words of 64 bits as are not zero come to the driver, BITS / 64 at most."""
    bit = lambda shift: F.struct((F.shiftrightunsigned("key", shift).bitwiseAND(F.lit(BITS - 1))).alias("at"))
    each = keys.select(F.explode(F.array(bit(0), bit(32))).alias("b")).select(F.shiftrightunsigned("b.at", 6).alias("word"), F.expr("shiftleft(1L, cast(b.at & 63 AS INT))").alias("bits"))
    out = np.zeros(BITS // 64, np.uint64)
    got = each.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _acyclic(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` without the search for cycles, of which tuples and lists of states have none."""

    def run(batches: Iterator) -> Iterator:
        gc.disable()
        try:
            yield from work(batches)
        finally:
            gc.enable()

    return releasing(run)


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def word_counts(texts: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, word, f) of words that occur ``least`` times, (lang, n) of all words)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _shards(batches):
            for lang, at, words in _positions(part):
                n = np.bincount(at[at >= 0], minlength=len(words))
                some = np.flatnonzero(n)
                held, counts = [words[k] for k in some.tolist()] + [""], np.append(n[some], n.sum())  # no word is empty: the total
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), pa.array(held, pa.string()), pa.array(counts)], names=["lang", "word", "f"])

    counted = texts.mapInArrow(releasing(count), "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    kept = materialize(counted.where((F.col("f") >= least) | (F.col("word") == "")), workspace(texts.sparkSession, "collocation"))
    return kept.where("word <> ''"), kept.where("word = ''").select("lang", F.col("f").alias("n"))


def word_keys(words: DataFrame) -> DataFrame:
    """64-bit keys of ``words`` (lang, word)."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = hashes([f"{lang}\t{w}" for lang, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist())])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["key"])

    return words.select("lang", "word").mapInArrow(key, "key long")


def frequent_pairs(texts: DataFrame, words: np.ndarray, least: int = LEAST) -> DataFrame:
    """Keys of pairs of neighbours whose words are frequent, and that may occur ``least`` times themselves."""
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _shards(batches):
            for lang, at, held in _positions(part):
                keys = _keys(lang, held)
                good = np.append(_held(shared.value, keys), False)[at] & (at >= 0)
                here = np.flatnonzero(good[:-1] & good[1:])
                pair, n = np.unique(_pair(keys[at[here]], keys[at[here + 1]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n)], names=["key", "n"])

    return texts.mapInArrow(releasing(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")


def _phrases(at: np.ndarray, keys: np.ndarray, rank: np.ndarray, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's phrases of two words or more in ascending order: (ranks of five words, number of words, count), from sorted positions that are cut at pairs that aren't frequent."""
    good = np.append(_held(words, keys), False)[at] & (at >= 0)
    step = np.zeros(len(at), bool)
    here = np.flatnonzero(good[:-1] & good[1:])
    step[here] = _held(pairs, _pair(keys[at[here]], keys[at[here + 1]]))
    ranks = np.where(good, rank[at] + 1, 0)
    starts = np.flatnonzero(step)
    columns, alive = [ranks[starts]], np.ones(len(starts), bool)
    for k in range(1, LONGEST):
        on = np.minimum(starts + k, len(at) - 1)
        alive = alive & step[on - 1] & (starts + k < len(at))
        columns.append(np.where(alive, ranks[on], 0))
    base = len(rank) + 1
    if base < 1 << 21:  # three words in one number, two in another
        order = np.lexsort((columns[3] * base + columns[4], (columns[0] * base + columns[1]) * base + columns[2]))
    else:
        order = np.lexsort(columns[::-1])
    rows = np.stack(columns, 1)[order]
    # where each prefix of so many words begins in the sorted rows, how often it occurs, and at what place it comes
    changed = np.ones(len(rows), bool)
    changed[1:] = rows[1:, 0] != rows[:-1, 0]
    firsts, sizes, counts = [], [], []
    for n in range(2, LONGEST + 1):
        changed[1:] |= rows[1:, n - 1] != rows[:-1, n - 1]
        begin = np.flatnonzero(changed)
        count = np.diff(np.append(begin, len(rows)))
        whole = rows[begin, n - 1] > 0
        firsts.append(begin[whole])
        counts.append(count[whole])
        sizes.append(np.full(int(whole.sum()), n))
    first, size, count = (np.concatenate(x) for x in (firsts, sizes, counts))
    place = np.lexsort((size, first))
    return rows[first[place]], size[place], count[place]


class Ranges:
    """Prefix ranges of phrases, from the prefixes (language, text) that too many words have."""

    def __init__(self, split: set[tuple[str, str]]):
        self.split = split

    def head(self, lang: str, word: str) -> tuple[str, bool]:
        """(prefix of the first word, whether the word is frequent enough to be parted by the second)."""
        for n in range(1, min(len(word), PREFIX) + 1):
            if (lang, word[:n]) not in self.split:
                return word[:n], False
        return word, True

    def of(self, lang: str, phrase: Sequence[str]) -> tuple[str, int]:
        """(prefix of the first word, first byte of the second word: 0 for a single word, and where the first needn't be parted)."""
        prefix, parted = self.head(lang, phrase[0])
        return prefix, phrase[1].encode()[0] if parted and len(phrase) > 1 else 0


def prefix_ranges(words: DataFrame) -> Ranges:
    """Ranges for ``words`` (lang, word, f). The prefixes that come to the driver have a share of at least 1 / ``RANGES`` of all words each, so for each length there are no more."""
    total = words.agg(F.sum("f").alias("n")).first()["n"] or 0
    begun = words.select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(PREFIX))), lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("prefix"), "f")
    return Ranges({(r["lang"], r["prefix"]) for r in begun.groupBy("lang", "prefix").agg(F.sum("f").alias("n")).where(F.col("n") * RANGES > total).collect()})


_RANGE = [("lang", pa.string()), ("prefix", pa.string()), ("part", pa.int32())]
_STORED = [("weights", pa.list_(pa.int64())), ("degrees", pa.list_(pa.int32())), ("labels", pa.list_(pa.string())), ("targets", pa.list_(pa.int32()))]
_STORED_SQL = "lang string, prefix string, part int, shard long, weights array<long>, degrees array<int>, labels array<string>, targets array<int>"


def _ranged(lang: str, said: Iterable[tuple[tuple[str, ...], int]], ranges: Ranges, shard: int) -> Iterator[dict]:
    """Rows of the transducers of sorted phrases, one a range."""
    heads = groupby(said, lambda p: p[0][0])
    for (prefix, parted), words in groupby(((ranges.head(lang, word), list(group)) for word, group in heads), lambda h: h[0]):
        same = chain.from_iterable(group for _, group in words)
        for part, group in groupby(same, lambda p: p[0][1].encode()[0] if len(p[0]) > 1 else 0) if parted else [(0, same)]:
            yield {"lang": lang, "prefix": prefix, "part": part, "shard": shard} | Transducer.of(group).row()


def word_transducers(words: DataFrame, ranges: Ranges) -> DataFrame:
    """The counts of ``words`` (lang, word, f) as transducers, several a range if its words lie in several tasks."""
    schema = pa.schema(_RANGE + [("shard", pa.int64())] + _STORED)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        yield from _batched((row for lang, group in groupby(stream, lambda r: r[0]) for row in _ranged(lang, (((w,), f) for _, w, f in group), ranges, -1)), schema)

    return words.select("lang", "word", "f").repartitionByRange("lang", "word").sortWithinPartitions("lang", "word").mapInArrow(build, _STORED_SQL)


def shard_transducers(texts: DataFrame, words: np.ndarray, pairs: np.ndarray, ranges: Ranges) -> DataFrame:
    """A count transducer for each shard and prefix range."""
    frequent, joined = (texts.sparkSession.sparkContext.broadcast(x) for x in (words, pairs))
    schema = pa.schema(_RANGE + [("shard", pa.int64())] + _STORED)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def rows() -> Iterator[dict]:
            for nth, part in enumerate(_shards(batches)):
                for lang, at, held in _positions(part):
                    order = sorted(range(len(held)), key=held.__getitem__)
                    rank = np.empty(len(held), np.int64)
                    rank[order] = np.arange(len(held))
                    named = ["", *(held[k] for k in order)].__getitem__
                    found, sizes, counts = _phrases(at, _keys(lang, held), rank, frequent.value, joined.value)
                    said = ((tuple(map(named, row[:size])), n) for row, size, n in zip(found.tolist(), sizes.tolist(), counts.tolist()))
                    yield from _ranged(lang, said, ranges, task << 20 | nth)

        yield from _batched(rows(), schema)

    return texts.mapInArrow(_acyclic(build), _STORED_SQL)


def united(stored: DataFrame, least: int = LEAST) -> DataFrame:
    """One transducer a range, of the phrases with a sum of ``least`` or more."""
    spark = stored.sparkSession
    schema = pa.schema(_RANGE + [("shard", pa.int64())] + _STORED)

    def merge(floor: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [n for n, _ in _RANGE + [("shard", None)] + _STORED]

            def rows() -> Iterator[dict]:
                stream = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n in names)))
                for key, group in groupby(stream, lambda r: r[:4]):
                    held: list[Transducer] = []
                    for r in group:
                        held.append(Transducer.read(*r[4:]))
                        if len(held) == UNITED:
                            held = [union(held)]
                    whole = union(held, floor)
                    if whole.arcs[whole.root]:
                        yield dict(zip(names, key)) | whole.row()

            yield from _batched(rows(), schema)

        return _acyclic(work)

    groups = stored.agg(F.count_distinct("shard").alias("n")).first()["n"]
    key = ["lang", "prefix", "part", "shard"]
    while True:
        groups = -(-groups // UNITED)
        salted = stored.withColumn("shard", F.pmod(F.xxhash64("shard"), F.lit(max(groups, 1))))
        merged = salted.repartition(*key).sortWithinPartitions(*key).mapInArrow(merge(0 if groups > 1 else least), _STORED_SQL)
        stored = materialize(merged, workspace(spark, "collocation"))
        if groups <= 1:
            break
    return stored.drop("shard")


def _read(row: dict) -> Transducer:
    return Transducer.read(row["weights"], row["degrees"], row["labels"], row["targets"])


def candidates(ranges: DataFrame) -> DataFrame:
    """lang, words and f of all phrases of two words or more."""
    schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("f", pa.int64())])

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(({"lang": r["lang"], "words": list(p), "f": w} for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist() for p, w in _read(r).phrases() if len(p) > 1), schema)

    return ranges.mapInArrow(say, "lang string, words array<string>, f long")


def part_counts(ranges: DataFrame, parts: DataFrame, known: Ranges) -> DataFrame:
    """(lang, words, f) of ``parts`` (lang, words), distinct: in each range their acceptor is composed with its transducer."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("weights", "array<long>"), ("degrees", "array<int>"), ("labels", "array<string>"), ("targets", "array<int>"))]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [known.of(lang, words) for lang, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p for p, _ in at], pa.string()), pa.array([p for _, p in at], pa.int32()), b.column(1)], names=["lang", "prefix", "part", "words"])

    asked = parts.select("lang", "words").mapInArrow(placed, "lang string, prefix string, part int, words array<string>").select("*", *none)
    key = ["lang", "prefix", "part"]
    both = ranges.withColumn("words", F.lit(None).cast("array<string>")).select(*asked.columns).unionByName(asked)
    schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("f", pa.int64())])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            stream = (r for b in batches for r in b.to_pylist())
            for (lang, _, _), group in groupby(stream, lambda r: (r["lang"], r["prefix"], r["part"])):
                counts = _read(next(group))  # nulls first: the range itself, then its parts in order
                acceptor = Transducer.of((tuple(r["words"]), 1) for r in group)
                for phrase, weight in counts.composed(acceptor):
                    yield {"lang": lang, "words": list(phrase), "f": weight}

        yield from _batched(rows(), schema)

    return both.repartition(*key).sortWithinPartitions(*key, F.col("words").asc_nulls_first()).mapInArrow(releasing(compose), "lang string, words array<string>, f long")


def _small(totals: DataFrame) -> DataFrame:
    """``totals`` for a broadcast if its names have a few bytes, for a shuffle otherwise."""
    size = totals.agg(F.sum(F.octet_length("lang") + 64).alias("n")).first()["n"] or 0
    return F.broadcast(totals) if size <= BROADCAST_BYTES else totals


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select("text", "lang")
    frequent, totals = word_counts(texts, least)
    words = _filter(word_keys(frequent))
    pairs = _filter(frequent_pairs(texts, words, least))
    known = prefix_ranges(frequent)
    stored = shard_transducers(texts, words, pairs, known).unionByName(word_transducers(frequent, known))
    ranges = united(materialize(stored, workspace(spark, "collocation")), least)
    found = materialize(candidates(ranges), workspace(spark, "collocation"))

    longer = found.where(F.size("words") > 2)
    inner = F.explode(F.array(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1)))
    covered = longer.select("lang", inner.alias("words"), F.col("f").alias("above")).groupBy("lang", "words").agg(F.max("above").alias("above"))
    free = found.join(covered, ["lang", "words"], "left").where(F.col("above").isNull() | (100 * F.col("above") < 100 * F.col("f"))).select("lang", "words", "f")
    free = materialize(free, workspace(spark, "collocation"))

    cuts = free.select("lang", "words", "f", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "words", "f", "k", F.slice("words", F.lit(1), F.col("k")).alias("left"), F.slice("words", F.col("k") + 1, F.size("words")).alias("right"))
    asked = cuts.select("lang", F.explode(F.array("left", "right")).alias("words")).distinct()
    counts = materialize(part_counts(ranges, asked, known), workspace(spark, "collocation"))
    part = lambda side, f: counts.select("lang", F.col("words").alias(side), F.col("f").alias(f))
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(_small(totals), "lang").withColumnRenamed("f", "a")
    best = scored.withColumn("score", F.expr(SCORE)).groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = best.select("lang", F.array_join("words", " ").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("_nth", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_nth") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
