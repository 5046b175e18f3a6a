"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

A text is the set of its shingles of five words (a shorter text with a word: one shingle of all
its words). Each tree of the forest labels a text with a sequence of short minhash values; sorted,
the labels form a prefix trie, whose nodes at a depth are the texts that share a prefix of that
length. The join begins with the deepest nodes of all tries. Then it shortens the prefixes, trie
by trie and value by value, until the chance that some trie brings a pair at the threshold itself
together reaches the target (``forest``); if prefixes of one value in all tries don't reach it, the
forest gets more tries from the start. So the target holds at any threshold. The pairs found have
no say in it: one large group of very similar texts would end the search for all others. At 0.8 and
0.9995 all twelve tries are shortened to four values, and seven of them to three.

Equal texts are one class from the start. Texts of a node are verified together, in blocks: a
node larger than ``BLOCK`` is split, and each pair of blocks is a task of its own. Exact numbers of
links need all pairs of a group of near copies, so a node of n texts that differ sends each of
them to ``n / block`` tasks; blocks grow with the node up to ``BLOCK_MOST`` texts to keep that low. A pair is
verified at the first trie whose prefix it shares, and only if no longer prefix did it before, so
links are counted once. Blocks return a link count and a root for each text, not the pairs, so
what leaves them is linear in the texts. Roots are joined to classes by alternating star
contractions.

Defined cases: a null text and a text without words have no shingles and no links; texts without
words are still equal to themselves, so their copies are one class, null texts are alone each;
repeated rows are copies; an empty table gives an empty result; columns beyond doc_id and text
are ignored by ``join`` and carried through ``keep_one``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm._arrays import mix, releasing, slices, word_hashes
from siftwork.llm._common import BROADCAST_ROWS, materialize, row_key, workspace

N, THRESHOLD = 5, 0.8
#: Trees at least, values of their labels, and the recall at the threshold at which no prefix is shortened further.
TREES, DEPTH, RECALL = 12, 5, 0.9995
#: Texts of a block in nodes of up to 16 blocks, and in the largest ones; shingles of a block; texts of a tile of a block; bytes of text that are worked on at once.
BLOCK, BLOCK_MOST, BLOCK_SHINGLES, TILE, TEXT = 1024, 8192, 4 << 20, 1024, 2 << 20


@dataclass(frozen=True)
class Forest:
    """``steps``: (length of the prefixes, number of tries that are cut to it), longest first."""

    trees: int
    steps: tuple[tuple[int, int], ...]

    def missed(self, similarity: float) -> float:
        """The chance that no trie brings a pair of this similarity together."""
        lengths = [DEPTH] * self.trees
        for depth, tries in self.steps:
            lengths[:tries] = [depth] * tries
        return math.prod(1 - similarity**n for n in lengths)


def forest(threshold: float, recall: float) -> Forest:
    """The forest that finds a pair at ``threshold`` with a chance of ``recall``, with prefixes as long as can be."""
    if not (0 < threshold <= 1 and 0 < recall < 1):
        raise ValueError(f"threshold {threshold} must be in (0, 1], recall {recall} in (0, 1): no number of tries finds pairs without shingles in common, or all pairs for certain")
    trees, steps = TREES, []
    if threshold < 1:
        trees = max(trees, math.ceil(math.log(1 - recall) / math.log(1 - threshold)))
    for depth in range(DEPTH, 0, -1):
        for tries in [trees] if depth == DEPTH else range(1, trees + 1):
            found = Forest(trees, (*steps, (depth, tries)))
            if 1 - found.missed(threshold) >= recall:
                return found
        steps.append((depth, trees))
    return found


@lru_cache
def _keys(values: int) -> np.ndarray:
    """Multiplier and offset of each minhash function."""
    return mix(np.arange(1, 2 * values + 1, dtype=np.uint64), 77).reshape(2, -1)


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; null for null."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def shingles(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the n-word shingles of all texts, their number by text), with repetitions."""
    h, sizes = word_hashes(texts)
    if not len(h):
        return h, sizes
    ends = np.cumsum(sizes)
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    acc = mix(h, 1)
    with np.errstate(over="ignore"):
        for k in range(1, n):
            nxt = np.concatenate([h[k:], np.zeros(min(k, len(h)), np.uint64)])
            acc = mix(acc * np.uint64(3) + nxt, 1)
    left = np.repeat(ends, sizes) - np.arange(len(h))
    keep = left >= n
    for d in np.flatnonzero((sizes > 0) & (sizes < n)).tolist():
        a = int(ends[d] - sizes[d])
        one = mix(h[a : a + 1], 2)
        with np.errstate(over="ignore"):
            for x in h[a + 1 : a + int(sizes[d])]:
                one = mix(one * np.uint64(3) + x, 2)
        acc[a], keep[a] = one[0], True
    return acc[keep], counts


def labels(s: np.ndarray, counts: np.ndarray, trees: int = TREES) -> np.ndarray:
    """(texts, trees, depth) minhash values of 16 bits; texts without shingles have zeros."""
    full, keys = np.flatnonzero(counts), _keys(trees * DEPTH)
    out = np.zeros((len(counts), trees * DEPTH), np.uint16)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        for j in range(out.shape[1]):
            with np.errstate(over="ignore"):
                low = np.minimum.reduceat(((s * (keys[0, j] | np.uint64(1)) + keys[1, j]) >> np.uint64(32)).astype(np.uint32), starts)
            out[full, j] = (mix(low.astype(np.uint64), j) & np.uint64(0xFFFF)).astype(np.uint16)
    return out.reshape(len(counts), trees, DEPTH)


def signatures(docs: DataFrame, trees: int = TREES) -> DataFrame:
    """doc_id, key, shingles (their number) and label (all trees' values in one binary) of every document."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, TEXT):
                s, counts = shingles(part.column(2))
                packed = labels(s, counts, trees)
                binary = pa.array([x.tobytes() for x in packed], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts), binary], names=["doc_id", "key", "shingles", "label"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text")
    return rows.mapInArrow(releasing(signed), "doc_id long, key binary, shingles long, label binary")


def _prefix(depth: int) -> Column:
    """Hash of a trie's number and its label's prefix: the node of the trie."""
    return F.xxhash64("tree", F.substring("label", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * depth)))


def _small(df: DataFrame) -> DataFrame:
    """``df``, a written table, for broadcast if its row count allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _groups(reps: DataFrame, depth: int, tries: int, before: int | None, path: str) -> DataFrame:
    """bucket, n (texts) and weight (shingles) of the nodes that hold pairs not verified before. Nodes with the same texts in several tries count once, at the first."""
    rows = reps.select("key", "label", "shingles", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("tree"))
    deep = _prefix(before) if before else F.lit(0)
    rows = rows.select("tree", "shingles", _prefix(depth).alias("bucket"), F.xxhash64("key").alias("k"), F.xxhash64(F.lit(1), "key").alias("l"), deep.alias("deep"))
    some = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("weight"), F.bit_xor("k").alias("set"), F.bit_xor("l").alias("also"),
        F.min("tree").alias("tree"), F.min("deep").alias("low"), F.max("deep").alias("high"),
    )
    some = some.where("n > 1" + (" and low <> high" if before else ""))
    return materialize(some.groupBy("n", "weight", "set", "also").agg(F.min_by("bucket", "tree").alias("bucket")).select("bucket", "n", "weight"), f"{path}/buckets-{depth}")


def _members(reps: DataFrame, groups: DataFrame, depth: int, tries: int) -> DataFrame:
    """bucket, tree, key, copies, label and the block and pair of blocks of each text in ``groups``."""
    rows = reps.select("key", "copies", "label", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("tree"))
    rows = rows.withColumn("bucket", _prefix(depth)).join(_small(groups), "bucket")
    size = F.least(F.greatest(F.lit(BLOCK), F.ceil(F.col("n") / 16)), F.lit(max(BLOCK, BLOCK_MOST)))
    blocks = F.greatest(F.ceil(F.col("n") / size), F.ceil(F.col("weight") / F.lit(BLOCK_SHINGLES))).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.select("bucket", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "tree", "key", "copies", "label")


RESULT = pa.schema([("key", pa.binary()), ("root", pa.binary()), ("links", pa.int64())])
RESULT_SCHEMA = "key binary, root binary, links long"


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (left, right): one by one, or by products of incidence matrices if there are many."""
    m = len(sets)
    if len(left) < 64 or len(left) * 200 < m * m:
        return np.array([np.intersect1d(sets[i], sets[j], assume_unique=True).size for i, j in zip(left.tolist(), right.tolist())], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    _, code, often = np.unique(flat, return_inverse=True, return_counts=True)
    keep = often[code] > 1
    code, owner = code[keep], owner[keep]
    if not len(code):
        return np.zeros(len(left), np.int64)
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    step = max(256, (1 << 23) // m)
    total = np.zeros((m, m), np.float32)
    for c in range(0, int(code[-1]) + 1, step):
        a, b = np.searchsorted(code, [c, c + step])
        seen = np.zeros((m, step), np.float32)
        seen[owner[a:b], code[a:b] - c] = 1
        total += seen @ seen.T
    return np.rint(total[left, right]).astype(np.int64)


def _roots(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node that each of ``m`` nodes is connected to by the edges (i, j)."""
    root = np.arange(m)
    while True:
        now = root.copy()
        np.minimum.at(now, i, root[j])
        np.minimum.at(now, j, root[i])
        now = now[now]
        if (now == root).all():
            return root
        root = now


def _tiles(blocks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places that a task compares, in parts: within its block, or between its two blocks."""
    sides = [np.flatnonzero(blocks == x) for x in np.unique(blocks)]
    parts = [[side[k : k + TILE] for k in range(0, len(side), TILE)] for side in sides]
    if len(sides) == 2:
        for left, right in itertools.product(*parts):
            yield np.repeat(left, len(right)), np.tile(right, len(left))
        return
    for a, left in enumerate(parts[0]):
        i, j = np.triu_indices(len(left), 1)
        yield left[i], left[j]
        for right in parts[0][a + 1 :]:
            yield np.repeat(left, len(right)), np.tile(right, len(left))


def verify(texts: pa.Array, keys: list[bytes], copies: np.ndarray, tries: np.ndarray, blocks: np.ndarray, tree: int, depth: int, before: int | None, threshold: float) -> list[tuple]:
    """Links of one block (or pair of blocks): rows of RESULT for the texts that have any.

    ``tries``: their labels. Pairs that an earlier trie or a longer prefix brought together are left out.
    """
    first = {}
    for k, key in enumerate(keys):
        first.setdefault(key, k)
    if len(first) < len(keys):  # repeated rows
        own = np.array(sorted(first.values()))
        texts, keys, copies, tries, blocks = texts.take(pa.array(own)), [keys[k] for k in own], copies[own], tries[own], blocks[own]
    m = len(keys)
    if m < 2:
        return []
    sets, size = [], np.zeros(0, np.int64)
    links, edges = np.zeros(m), []
    for i, j in _tiles(blocks):
        for t in range(tree):
            new = np.flatnonzero((tries[i, t, :depth] != tries[j, t, :depth]).any(1))
            i, j = i[new], j[new]
        same = np.flatnonzero((tries[i, tree, :depth] == tries[j, tree, :depth]).all(1))
        i, j = i[same], j[same]
        if before:
            for t in range(tries.shape[1]):
                new = np.flatnonzero((tries[i, t, :before] != tries[j, t, :before]).any(1))
                i, j = i[new], j[new]
        if not len(i):
            continue
        if not sets:
            s, counts = shingles(texts)
            cuts = np.concatenate([[0], np.cumsum(counts)])
            sets = [np.unique(s[a:b]) for a, b in zip(cuts, cuts[1:])]
            size = np.array([len(x) for x in sets])
        near = np.flatnonzero(np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9)
        i, j = i[near], j[near]
        own, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        both = _overlaps([sets[k] for k in own.tolist()], place[: len(i)], place[len(i) :])
        similarity = both / np.maximum(size[i] + size[j] - both, 1)
        linked = np.flatnonzero(similarity >= threshold - 1e-12)
        i, j = i[linked], j[linked]
        links += np.bincount(i, copies[j], m) + np.bincount(j, copies[i], m)
        root = _roots(m, i, j)
        moved = np.flatnonzero(root != np.arange(m))
        edges.append((moved, root[moved]))
    if not links.any():
        return []
    root = _roots(m, *(np.concatenate(x) for x in zip(*edges)))
    return [(keys[k], keys[root[k]], int(links[k])) for k in np.flatnonzero(links).tolist()]


def _verified(members: DataFrame, texts: DataFrame, depth: int, before: int | None, threshold: float) -> DataFrame:
    """Blocks are laid side by side in sorted partitions and verified one after the other."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables of whole blocks of about TEXT bytes, or of one block."""
        held: pa.Table | None = None
        for batch in batches:
            for part in slices(batch, 8, TEXT):
                held = pa.concat_tables([held, pa.Table.from_batches([part])]) if held is not None else pa.Table.from_batches([part])
                key = np.stack([held.column(k).to_numpy() for k in range(3)], 1)
                cut = np.flatnonzero((key[1:] != key[:-1]).any(1))
                if len(cut):
                    yield held.slice(0, int(cut[-1]) + 1)
                    held = held.slice(int(cut[-1]) + 1)
        if held is not None and held.num_rows:
            yield held

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches):
            table = table.combine_chunks()
            key = np.stack([table.column(k).to_numpy() for k in range(3)], 1)
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]])
            blocks, trees, copies = (table.column(k).to_numpy() for k in (3, 4, 6))
            keys, texts = table.column(5).to_pylist(), table.column(8).chunk(0)
            tries = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint16).reshape(len(keys), -1, DEPTH)
            rows: list[tuple] = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                rows += verify(texts.slice(a, b - a), keys[a:b], copies[a:b], tries[a:b], blocks[a:b], int(trees[a]), depth, before, threshold)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(RESULT)], schema=RESULT)

    rows = members.join(texts, "key").select("bucket", "a", "b", "block", "tree", "key", "copies", "label", "text")
    return rows.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b").mapInArrow(releasing(checked), RESULT_SCHEMA)


def components(edges: DataFrame, path: str) -> DataFrame:
    """node, component of the graph of ``edges`` (u, v): alternating large and small stars until nothing changes.

    Every round is written; the driver sees a count and a checksum.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    def star(e: DataFrame, large: bool, name: str) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        low = materialize(low, f"{path}/low-{name}")  # a table of its own: the neighbours of a large component's root can then be split
        joined = both.join(low, "u")
        if large:  # neighbours above a node go to its least neighbour
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:  # neighbours below a node, and the node, go to the least of them
            out = joined.where("v < u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.where("m < u").select("u", F.col("m").alias("v")))
        return materialize(out.where("u <> v").distinct(), f"{path}/{name}")

    edges = materialize(edges.where("u <> v").distinct(), f"{path}/edges")
    now = state(edges)
    for k in itertools.count():
        edges = star(star(edges, True, f"large-{k}"), False, f"small-{k}")
        last, now = now, state(edges)
        if now == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, path: str | None = None) -> DataFrame:
    """doc_id, class_id, n_links and text_id of every document.

    class_id: least id among the documents that links lead to; text_id: least id with the same
    text; n_links: other documents of a similarity of ``threshold`` or more.
    """
    return _classes(docs, threshold, recall, path or workspace(docs.sparkSession, "join")).select("doc_id", "class_id", "n_links", "text_id")


def _classes(docs: DataFrame, threshold: float, recall: float, path: str) -> DataFrame:
    tries = forest(threshold, recall)
    signed = materialize(signatures(docs, tries.trees), f"{path}/signatures")
    same = signed.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("text_id"), F.max("shingles").alias("shingles"), F.min("label").alias("label"))
    same = materialize(same, f"{path}/texts")
    reps = same.where("shingles > 0").select("key", "copies", "label", "shingles")
    source = docs.select(text_key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("_id"), "text")
    before, every = None, None
    for depth, cut in tries.steps:
        groups = _groups(reps, depth, cut, before, path)
        members = materialize(_members(reps, groups, depth, cut), f"{path}/members-{depth}")
        wanted = materialize(members.select("key").distinct().join(same.select("key", "text_id"), "key"), f"{path}/wanted-{depth}")
        texts = source.join(_small(wanted), "key").where(F.col("_id").eqNullSafe(F.col("text_id"))).select("key", "text")
        found = materialize(_verified(members, texts, depth, before, threshold), f"{path}/links-{depth}")
        every, before = found if every is None else every.unionByName(found), depth
    links = every.groupBy("key").agg(F.sum("links").alias("links"))
    parts = components(every.select(F.col("key").alias("u"), F.col("root").alias("v")), path)
    top = parts.join(same.select(F.col("key").alias("node"), "text_id"), "node").groupBy("component").agg(F.min("text_id").alias("low"))
    top = top.join(same.select(F.col("key").alias("component"), "text_id"), "component").select("component", F.least("low", "text_id").alias("class_id"))
    named = parts.join(top, "component").select(F.col("node").alias("key"), "class_id", "component").unionByName(top.select(F.col("component").alias("key"), "class_id", "component"))
    texts = same.select("key", "copies", "text_id").join(named, "key", "left").join(links, "key", "left")
    n_links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    texts = texts.select("key", "text_id", F.coalesce("component", "key").alias("component"), F.coalesce("class_id", "text_id").alias("class_id"), n_links.alias("n_links"))
    texts = materialize(texts, f"{path}/named")  # a table of its own: Spark can then split a hot text's side of the join
    rows = signed.select("doc_id", "key").join(texts, "key", "left")
    of = lambda c: F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col(c)).alias(c)
    return rows.select("doc_id", "key", "component", of("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), of("text_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The documents without the near copies: of each class the one with the least id stays, with all its columns.

    A class is what links and equal texts join, whatever its ids: ids may repeat or be null (a null
    comes after all others), and of texts under one id the one with the least key stays. Only the
    ids and text keys that go are joined to the documents. Of rows with one id and text, the one
    whose columns have the least digest stays.
    """
    path = workspace(docs.sparkSession, "keep")
    classes = materialize(_classes(docs, threshold, recall, path), f"{path}/classes")
    some = classes.where("key is not null")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    kept = some.groupBy("component").agg(F.min(rank).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    kept = materialize(kept.withColumnRenamed("component", "_component"), f"{path}/kept")  # a table of its own: the rows of a large class can then be split
    goes = some.join(kept, F.col("component") == F.col("_component"))
    goes = goes.where(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("key") == F.col("kept.key")))).select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).distinct()
    goes = materialize(goes, f"{path}/goes")
    twice = some.groupBy("doc_id", "key").count().where("count > 1").select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"))
    twice = materialize(twice, f"{path}/twice")
    # the documents' own columns travel in a struct, so they may have any names
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    on = F.col("gone_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("gone_key"))
    left = rows.join(_small(goes), on, "left_anti")
    if not twice.isEmpty():
        digest = F.unhex(F.sha2(F.to_json("doc"), 256))
        one = left.join(_small(twice), on, "left_semi").groupBy("id", "key").agg(F.min_by("doc", digest).alias("doc"))
        left = left.join(_small(twice), on, "left_anti").unionByName(one.select(*left.columns))
    return left.select("doc.*")
