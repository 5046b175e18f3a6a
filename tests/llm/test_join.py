"""The n-gram join against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from siftwork.llm import ngram_join as nj

SCHEMA = "doc_id long, text string, class_id string"


def sets(texts):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().split()
        out[i] = frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute(texts, threshold=0.8):
    """(links, class) of each id by comparing all pairs; texts that are equal are one class."""
    s, links, root = sets(texts), defaultdict(int), {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(s[i] & s[j])
            near = s[i] and s[j] and both / (len(s[i]) + len(s[j]) - both) >= threshold
            if near or (texts[i] is not None and texts[i] == texts[j]):
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: links[i] for i in ids}, {i: find(i) for i in ids}


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    texts, n = {}, 0
    for t in (None, None, "", "", " \n", "one two", "one two", "one  two", "a b c d e"):
        texts[n] = t
        n += 1
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(20, 250))]
        texts[n] = " ".join(base)
        n += 1
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 25) + 1)):
                copy[rng.randrange(len(copy))] = word()
            texts[n] = " ".join(copy)
            n += 1
    hot = [word() for _ in range(120)]
    for k in range(60):
        copy = list(hot)
        if k % 3:
            copy[(k * 37) % 120] = f"v{k}"
        texts[n] = "\t".join(copy)
        n += 1
    texts[n] = " ".join(word() for _ in range(30_000))
    return texts


def test_join_equals_all_pairs(spark):
    texts = corpus()
    got = nj.join(spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], SCHEMA)).collect()
    links, classes = brute(texts)
    assert len(got) == len(texts)
    assert {r.doc_id: r.class_id for r in got} == classes
    assert {r.doc_id: r.n_links for r in got} == links


def test_blocks_are_split(spark, monkeypatch):
    """Groups above the block size meet in pairs of blocks and give the same links."""
    texts = corpus(2)
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], SCHEMA)
    whole = sorted(nj.join(df).collect())
    monkeypatch.setattr(nj, "BLOCK", 16)
    assert sorted(nj.join(df).collect()) == whole


def test_keep_one(spark):
    texts = corpus(3)
    rows = [(i, t, f"c{i}") for i, t in texts.items()]
    out = nj.keep_one(spark.createDataFrame(rows + [rows[-1], rows[10]], SCHEMA)).collect()
    _, classes = brute(texts)
    assert sorted(r.doc_id for r in out) == sorted(i for i in texts if classes[i] == i)
    assert all(r.class_id == f"c{r.doc_id}" and r.text == texts[r.doc_id] for r in out)


def test_keep_one_with_columns_of_any_name(spark):
    names = ["gone_id", "__gone_id", "__gone_key", "__one_id", "key", "id", "doc", "digest", "kept", "component"]
    texts = corpus(3)
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in texts.items()]
    out = nj.keep_one(spark.createDataFrame(rows + [r for r in rows[:9] if (r[1] or "").strip()], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)))
    _, classes = brute(texts)
    assert out.columns == ["doc_id", "text", *names] and sorted(map(tuple, out.collect())) == sorted(r for r in rows if classes[r[0]] == r[0])


def test_keep_one_with_null_and_clashing_ids(spark):
    """Unrelated texts stay, whatever their ids; of near copies one stays."""
    words = lambda name, n=40: " ".join(f"{name}{k}" for k in range(n))
    rows = [(None, words("a")), (None, words("b")), (None, words("b")), (None, words("c")), (None, words("c", 41)), (None, ""), (None, None), (None, None)]
    rows += [(7, words("d")), (7, words("e")), (7, words("f")), (7, words("f", 41)), (9, words("g")), (None, words("g")), (None, words("g", 41)), (3, words("g", 42))]
    rows += [(5, words("h")), (5, words("h")), (5, words("i")), (6, words("i", 41)), (1, words("j")), (2, words("j", 41)), (2, words("k"))]
    out = nj.keep_one(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)).collect()
    kinds = sorted((r.text or str(r.text))[:1] for r in out)
    assert kinds == sorted(["N", "N", "", *"abcdefghijk"])
    ids = {(r.text or " ")[0]: r.doc_id for r in out}
    assert ids == {" ": None, "a": None, "b": None, "c": None, "d": 7, "e": 7, "f": 7, "g": 3, "h": 5, "i": 5, "j": 1, "k": 2}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nj.join(empty).collect() == [] and nj.keep_one(empty).collect() == []


def test_overlaps_agree():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 400, (150, 90)).astype(np.uint64)
    own = [np.unique(x) for x in pool]
    i, j = np.triu_indices(len(own), 1)
    want = [len(set(own[a].tolist()) & set(own[b].tolist())) for a, b in zip(i, j)]
    assert nj._overlaps(own, i, j).tolist() == want and nj._overlaps(own, i[:9], j[:9]).tolist() == want[:9]


def test_shingles():
    s, n = nj.shingles(pa.array(["a b c d e f", None, "a b", "b c d e f", ""]))
    assert n.tolist() == [2, 0, 1, 1, 0] and s[1] == s[3]


def test_recall_of_the_forest():
    """At any threshold the target is met, and one prefix less shortened would not meet it."""
    assert nj.forest(0.8, 0.9995).steps == ((5, 12), (4, 12), (3, 7))
    for threshold in (0.05, 0.1, 0.3, 0.4, 0.5, 0.7, 0.8, 0.9, 0.99, 1.0):
        for recall in (0.9, 0.9995):
            found = nj.forest(threshold, recall)
            assert 1 - found.missed(threshold) >= recall
            depth, tries = found.steps[-1]
            if depth < nj.DEPTH and tries > 1:
                assert 1 - nj.Forest(found.trees, (*found.steps[:-1], (depth, tries - 1))).missed(threshold) < recall
    for bad in ((0.0, 0.9), (1.2, 0.9), (0.5, 1.0)):
        with pytest.raises(ValueError):
            nj.forest(*bad)


@pytest.mark.parametrize("threshold", [0.3, 0.4, 0.6, 0.9])
def test_recall_against_brute_force(spark, threshold):
    """Planted pairs a little above the threshold, unrelated otherwise."""
    rng, rows = random.Random(7), []
    for k in range(120):
        base = [f"p{k}w{x}" for x in range(100)]
        shared = int(len(base) * 2 * (threshold + 0.02) / (1 + threshold + 0.02)) + 5
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:shared] + [f"q{k}w{x}" for x in range(100 - shared)]))]
    rng.shuffle(rows)
    got = nj.join(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA), threshold, 0.999).collect()
    links, classes = brute(dict(rows), threshold)
    assert sum(links.values()) == 240
    assert sum(r.n_links == links[r.doc_id] for r in got) >= 0.99 * len(got)
    assert sum(r.class_id == classes[r.doc_id] for r in got) >= 0.99 * len(got)


def test_a_large_group_does_not_end_the_search(spark, monkeypatch):
    """Whatever pairs were found, prefixes shorten until the chance at the threshold is high enough."""
    steps, groups = [], nj._groups
    monkeypatch.setattr(nj, "_groups", lambda reps, depth, tries, before, path: steps.append((depth, tries)) or groups(reps, depth, tries, before, path))
    hot = [f"h{k}" for k in range(400)]
    rows = [(k, " ".join([*hot, f"v{k}"]), "x") for k in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.n_links for r in nj.join(df).collect()} == {49}
    assert tuple(steps) == nj.forest(nj.THRESHOLD, nj.RECALL).steps
    steps.clear()
    nj.join(df, 0.95).collect()
    assert steps == [(5, 12)]


def test_null_and_equal_ids(spark):
    """Classes hold by text, whatever the ids."""
    words = lambda name, n=40: " ".join(f"{name}{k}" for k in range(n))
    rows = [(None, words("a")), (None, words("a", 41)), (4, words("b")), (4, words("c")), (4, words("c", 41)), (None, words("d")), (9, words("d"))]
    got = {(r.doc_id, r.class_id, r.n_links) for r in nj.join(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)).collect()}
    assert got == {(None, None, 1), (4, 4, 0), (4, 4, 1), (None, 9, 1), (9, 9, 1)}


def test_of_equal_rows_one_and_the_same_stays(spark):
    """Equal ids and texts with other columns: the choice doesn't depend on the order."""
    rows = [(1, "x y z", f"c{k}") for k in range(20)]
    kept = [nj.keep_one(spark.createDataFrame(x, SCHEMA)).collect() for x in (rows, rows[::-1])]
    assert len(kept[0]) == 1 and kept[0] == kept[1]


def test_tiles_and_heavy_texts(spark, monkeypatch):
    """Blocks split by shingles and compared in tiles give the same links."""
    df = spark.createDataFrame([(i, t, "x") for i, t in corpus(4).items()], SCHEMA)
    whole = sorted(nj.join(df).collect())
    monkeypatch.setattr(nj, "TILE", 7)
    monkeypatch.setattr(nj, "BLOCK_SHINGLES", 2000)
    assert sorted(nj.join(df).collect()) == whole


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 480)] + [(500, k) for k in range(501, 560)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    from siftwork.llm._common import workspace

    got = nj.components(spark.createDataFrame(edges, "u long, v long"), workspace(spark, "cc")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in root if find(x) != x}
