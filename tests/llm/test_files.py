"""Sharding, media, chat, WARC, language model and BPE: exact round trips and brute force."""

import gzip
import hashlib
import io
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwork.llm import bpe, chat, lm, media, sharding, warc
from siftwork.llm._common import open_fs, workspace

SCHEMA = "doc_id long, text string, shard string, key string"
LONG = " ".join(f"w{k % 977}" for k in range(40_000))
TEXTS = [None, "", "a", "same", "same", "same", "é漢\0", "\0\0", "x" * 64, "y" * 63, LONG, "Aa bB aa", " ", "aa\nbb\x85cc"]


def docs(spark, texts=TEXTS):
    rows = [(k, t, "clash", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[3:4], SCHEMA)


@pytest.mark.parametrize("run", [sharding.shard, media.roundtrip, lm.score])
def test_empty_documents(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []


# sharding
def check_shards(rows, n=8):
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts[k] for k in range(n)) <= 1
    for k in range(n):
        assert sorted(r.slot for r in rows if r["shard"] == k) == list(range(counts[k]))


def test_shards(spark):
    texts = [f"text {k % 150}" if k % 3 else f"alone {k}" for k in range(900)] + [None] * 5
    got = sharding.shard(docs(spark, texts)).collect()
    assert len(got) == 906
    check_shards(got)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    groups = Counter()
    for r in got:
        groups[texts[r.doc_id], r["shard"]] += 1
    linked = {t for t, c in Counter(texts).items() if c > 1 and t}
    split = [t for t in linked if len([1 for (x, _) in groups if x == t]) > 1]
    assert len(split) <= 0.1 * len(linked)


def test_shards_with_a_group_of_a_third(spark):
    texts = ["hot"] * 400 + [f"t{k}" for k in range(800)]
    got = sharding.shard(docs(spark, texts)).collect()
    check_shards(got)
    assert len({r["shard"] for r in got if texts[r.doc_id] == "hot"}) <= 5


@pytest.mark.parametrize("size", [2, 6])
def test_shards_with_all_rows_linked(spark, size):
    """Fewer groups are cut than there are shards."""
    texts = [f"text {k % (1800 // size)}" for k in range(1800)]
    got = sharding.shard(docs(spark, texts)).collect()
    check_shards(got)
    held = {}
    for r in got:
        held.setdefault(texts[r.doc_id], set()).add(r["shard"])
    assert sum(len(x) > 1 for x in held.values()) < 8


def test_groups_above_a_bucket_stay_whole(spark, monkeypatch):
    """A group that fits a shard is not spread, whatever the rows of a bucket."""
    monkeypatch.setattr(sharding, "BUCKET", 20)
    texts = [f"text {k % 14}" for k in range(980)] + [f"alone {k}" for k in range(20)]
    got = sharding.shard(docs(spark, texts), 4).collect()
    check_shards(got, 4)
    held = {}
    for r in got:
        held.setdefault(texts[r.doc_id], set()).add(r["shard"])
    assert sum(len(x) > 1 for x in held.values()) < 4


def test_pack():
    """Every group is placed, quotas hold, and only what no room holds is cut."""
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 9)
        tally = {(rng.choice([2, 3, 4, 7, 30, 200]), rng.randrange(-1, n)): rng.randrange(1, 30) for _ in range(rng.randrange(1, 20))}
        total = sum(s * c for (s, _), c in tally.items()) + rng.choice([0, 0, 5, 500])
        quota = [total // n + (k < total % n) for k in range(n)]
        runs, cuts = sharding.pack(tally, quota)
        used, placed = [0] * n, Counter()
        for key, parts in runs.items():
            for c, shard in parts:
                used[shard] += c * key[0]
                placed[key] += c
        for key, parts in cuts:
            assert sum(c for c, _ in parts) == key[0] and all(c for c, _ in parts)
            placed[key] += 1
            for c, shard in parts:
                used[shard] += c
        assert placed == tally and all(u <= q for u, q in zip(used, quota))
        assert sum(key[0] <= max(quota) for key, _ in cuts) < n
    runs, cuts = sharding.pack({(5, 0): 1, (4, 1): 1, (3, -1): 3}, [9, 9])
    assert not cuts


def test_fewer_rows_than_shards(spark):
    got = sharding.shard(docs(spark, ["a", "a", "b"])).collect()
    assert len(got) == 3 and max(Counter(r["shard"] for r in got).values()) == 1


# media
def test_media_roundtrip(spark):
    got = media.roundtrip(docs(spark)).collect()
    assert len(got) == len(TEXTS) + 1
    by_text = {}
    for r in got:
        raw = (TEXTS[r.doc_id] or "").encode()
        payload = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert by_text.setdefault(raw, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def test_media_ranges_and_damage(spark):
    """Any range size gives each member once; a damaged member alone is lost."""
    path = workspace(spark, "damage")
    media.store_texts(docs(spark).coalesce(1), path)
    whole = sorted(r.key for r in media.read(spark, path).collect())
    assert sorted(r.key for r in media.read(spark, path, 700).collect()) == whole
    fs, root = open_fs(path)
    from pyarrow import fs as pafs

    tar = next(i.path for i in fs.get_file_info(pafs.FileSelector(root)) if i.path.endswith(".tar"))
    with open(tar, "r+b") as f:
        f.seek(512 + 20)
        f.write(b"????")
    rows = media.read(spark, path).collect()
    bad = [r for r in rows if r.error]
    assert len(rows) == len(whole) and len(bad) == 1 and bad[0].media is None and "check sum" in bad[0].error
    lost = media.features(media.read(spark, path)).where("n_bytes is null").collect()
    assert len(lost) == 1 and "check sum" in lost[0].error


def test_media_above_a_million(spark):
    """One rule for the shape at any size."""
    texts = ["é" * 700_000, "x" * 64, ""]
    got = {r.doc_id: r for r in media.roundtrip(docs(spark, texts + ["a", "b"])).collect()}
    for k, t in enumerate(texts):
        raw = t.encode()
        payload = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        assert (got[k].n_bytes, got[k].payload_sha256) == (len(raw), hashlib.sha256(payload).hexdigest())
        assert got[k].feature.startswith(f"{len(payload)}x1;")


@given(st.binary(max_size=300))
@settings(max_examples=60, deadline=None)
def test_png(raw):
    samples, n = media.from_png(media.to_png(raw))
    assert samples.tobytes()[:n] == raw and n == len(raw) and samples.size % 64 == 0


# chat
TURNS = "conv_id long, turn long, role string, text string, node string"


def conversations():
    rng, rows = random.Random(1), []
    for c in range(60):
        said = "</s>[INST] \\l <|end|> [/INST]" if c % 7 == 0 else f"hello {c % 3}"
        rows += [(c, 0, "user", said, "x"), (c, 1, "assistant", None if c % 5 == 0 else f"answer {c % 4}", "x")]
        rows += [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["é<", "", "[b]", "\\", "tail " * 40]), "x") for t in range(2, 2 + c % 6)]
    return [*rows, (None, 0, "user", "no id", "x"), (None, 0, "assistant", "no id either", "x"), (5, 1, "assistant", "twice", "x"), (5, 1, "assistant", "twice", "x")]


@pytest.mark.parametrize("pack", [1 << 17, 200])
def test_chat_roundtrip(spark, pack):
    rows = conversations()
    packs = chat.format_conversations(spark.createDataFrame(rows, TURNS), pack)
    found, by = chat.read_back(packs).collect(), {}
    alone = lambda c, role: c if c is not None else f"none {role}"
    got = {alone(r.conv_id, "assistant" if r.loss_chars else "user"): r for r in found}
    for c, t, role, text, _ in rows:
        by.setdefault(alone(c, role), []).append((t, role or "", text or ""))
    assert len(found) == len(by) and packs.agg(F.sum(F.size("members"))).first()[0] == len(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.render(role, text)[0]) for _, role, text in turns)


def test_chat_shares_prefixes(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if t < 3 else f"own {c}", "x") for c in range(50) for t in range(4)]
    packs = chat.format_conversations(spark.createDataFrame(rows, TURNS).coalesce(1)).collect()
    assert sum(len(p.nodes) for p in packs) <= 50 + 3 * len(packs)
    for p in packs:
        for k, n in enumerate(p.nodes):
            path, at = [], n.parent
            while at >= 0:
                path.append(at)
                at = p.nodes[at].parent
            assert n.position == sum(p.nodes[a].stop - p.nodes[a].start for a in path)
            covered = {x for i in n.attends for x in range(i.start, i.stop)}
            assert covered == {x for a in path for x in range(p.nodes[a].start, p.nodes[a].stop)}
            assert k == 0 or n.start == p.nodes[k - 1].stop


@given(st.text(alphabet="\\lb<[|>é", max_size=30))
@settings(max_examples=100, deadline=None)
def test_escapes(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and "<" not in safe and "[" not in safe


def test_chat_empty(spark):
    assert chat.roundtrip(spark.createDataFrame([], TURNS)).collect() == []


# WARC
PAGES = "page_id long, url string, html string, payload string"


def pages():
    big = "<p>same</p>" * 30
    rows = [(9, "http://a/", big, "x"), (3, "http://b/\r\nEvil: 1", big, "x"), (5, None, big, "x"), (4, "u", "short", "x"), (2, "u", "short", "x"), (7, "u", None, "x"), (None, "u", "", "x"), (None, "v", big, "x"), (8, "u", "WARC/1.1\r\n" + big, "x"), (6, "é", "漢" * 5000, "x")]
    return [*rows, rows[0]]


def test_warc_roundtrip(spark):
    got = warc.roundtrip(spark.createDataFrame(pages(), PAGES)).collect()
    assert len(got) == 11
    for r in got:
        html = next((h or "") for p, _, h, _ in pages() if p == r.page_id and (p is not None or len(h or "") == r.payload_bytes))
        raw = html.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        first = min((p for p, _, h, _ in pages() if p is not None and (h or "") == html), default=None)
        assert (r.record_type, r.refers_to) == (("revisit", first) if len(raw) >= 100 and first != r.page_id else ("response", None))
        if r.refers_to is not None:
            assert r.refers_to_record == next(x.record_id for x in got if x.page_id == first)


def test_warc_reads_ranges_in_tasks_of_their_own(spark):
    """As many partitions with records as ranges that hold any, whatever adaptive execution would coalesce."""
    path = workspace(spark, "warc")
    rows = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html"))
    manifest = warc.write(rows.coalesce(2), path)
    step = 20_000
    ranges = sum(-(-r.bytes // step) for r in manifest.collect())
    got = warc.read(spark, path, manifest, step).where("kind = 'record'").select("page_id", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.page_id for r in got) == list(range(400))
    assert ranges > 8 and len({r.task for r in got}) >= 0.9 * ranges


def test_warc_quarantine(spark):
    """A damaged archive gives the other records, and a log of the bytes that were lost."""
    path = workspace(spark, "warc")
    rows = spark.range(60).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html"))
    manifest = warc.write(rows.coalesce(1), path)
    fs, root = open_fs(path)
    name = manifest.first().archive
    whole = sorted((r.offset, r.length, r.page_id) for r in warc.read(spark, path, manifest).collect())
    with open(f"{root}/{name}", "r+b") as f:
        f.seek(whole[20][0] + 40)
        f.write(b"damage")
    got = warc.recover(spark, path, manifest).collect()
    assert sorted(r.page_id for r in got) == sorted({r[2] for r in whole} - {whole[20][2]})
    log = warc.quarantine(spark, path).collect()
    assert [(r.archive, r.offset, r.length) for r in log] == [(name, *whole[20][:2])] and log[0].reason


def test_warc_long_page(spark):
    """A page above every read size comes back whole."""
    html = "<p>long</p>" * 800_000
    got = warc.roundtrip(spark.createDataFrame([(1, "u", html, "x"), (None, "u", html, "x")], PAGES)).collect()
    assert {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got} == {(1, "response", None, len(html)), (None, "revisit", 1, len(html))}


def test_warc_empty(spark):
    assert warc.roundtrip(spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("step", [10_000_000, 1000])
def test_salvage(compressed, step):
    """A damaged record costs itself; gaps tell which bytes; byte ranges find each record once."""
    if step == 1000 and not compressed:
        pytest.skip("plain archives are one range")
    rng = random.Random(3)
    raws = [warc.build(k, f"http://h/{k}", bytes(rng.choices(range(32, 127), k=50 + 90 * (k % 4))), None) for k in range(40)]
    parts = [gzip.compress(r, mtime=0) if compressed else r for r in raws]
    hurt = {0, 7, 8, 39}
    for k in hurt:
        at = len(parts[k]) // 2 if compressed else len(parts[k]) - 30  # plain headers have no check sum
        parts[k] = parts[k][:at] + bytes(b ^ 0x5A for b in parts[k][at : at + 4]) + parts[k][at + 4 :]
    data = b"".join(parts)
    starts = np.cumsum([0] + [len(p) for p in parts]).tolist()
    found = [x for a in range(0, len(data), step) for x in warc.salvage(io.BytesIO(data), len(data), a, a + step, compressed)]
    good = [x for x in found if x.head is not None]
    assert [int(x.head["warc-page"]) for x in good] == [k for k in range(40) if k not in hurt]
    assert [(x.start, x.end) for x in good] == [(starts[k], starts[k + 1]) for k in range(40) if k not in hurt]
    lost = {b for x in found if x.head is None for b in range(x.start, x.end)}
    want = {b for k in hurt for b in range(starts[k], starts[k + 1])}
    assert lost == want if step > len(data) else lost >= want


def test_gaps_of_ranges_are_those_of_one_read(spark):
    """Damage to each record in turn, and to neighbours, read in ranges of several sizes."""
    raws = [warc.build(k, f"https://e.example/{k}", bytes([65 + k % 26]) * (200 + 37 * k), None) for k in range(25)]
    rows, want = [], set()
    for compressed in (True, False):
        parts = [gzip.compress(r, mtime=0) if compressed else r for r in raws]
        starts = np.cumsum([0] + [len(p) for p in parts]).tolist()
        for hurt in [(k,) for k in range(25)] + [(0, 1), (23, 24), (5, 6, 9)]:
            data = b"".join(p[: len(p) // 2] + b"\0\1\2\3" + p[len(p) // 2 + 4 :] if k in hurt and compressed else b"Z" * len(p) if k in hurt else p for k, p in enumerate(parts))
            for step in (300, 1500, 10**9):
                name = f"{compressed}-{hurt}-{step}"
                rows += [("record" if x.head is not None else "stretch", name, x.start, x.end - x.start, x.reason) for a in range(0, len(data), step) for x in warc.salvage(io.BytesIO(data), len(data), a, a + step, compressed)]
                lost = sorted({b for k in hurt for b in (starts[k], starts[k + 1])})
                lost = [b for b in lost if not (b in [starts[k] for k in hurt] and b in [starts[k + 1] for k in hurt])]
                want |= {(name, a, b - a) for a, b in zip(lost[::2], lost[1::2])}
    got = warc.gaps(spark.createDataFrame(rows, "kind string, archive string, offset long, length long, reason string")).collect()
    assert len(got) == len(want) and {(r.archive, r.offset, r.length) for r in got} == want and all(r.reason for r in got)


# language model
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Model:
    """The model from exact counts by plain loops; only the counts of pairs and triples are rounded to their levels."""

    def __init__(self, train):
        self.words, self.pairs, self.triples = Counter(), Counter(), Counter()
        for w in train:
            self.words.update(w)
            self.pairs.update(zip(w, w[1:]))
            self.triples.update(zip(w, w[1:], w[2:]))
        self.n, self.v = sum(self.words.values()), len(self.words)

    def level(self, c):
        return float(lm.MEANS[lm.levels(np.array([c]))[0]]) if c else 0.0

    def p(self, w, before):
        p = (self.words[w] + 0.1) / (self.n + 0.1 * (self.v + 1))
        if before and self.words[before[-1]]:
            whole = self.words[before[-1]]
            p = (min(self.level(self.pairs[before[-1], w]), whole) + lm.PRIORS[2] * p) / (whole + lm.PRIORS[2])
        if len(before) > 1 and self.pairs[tuple(before[-2:])]:
            whole = self.level(self.pairs[tuple(before[-2:])])
            p = (min(self.level(self.triples[(*before[-2:], w)]), whole) + lm.PRIORS[3] * p) / (whole + lm.PRIORS[3])
        return p

    def score(self, w):
        return sum(math.log10(self.p(x, w[max(0, k - 2) : k])) for k, x in enumerate(w))


def words_of(text):
    return (text or "").translate(LOWER).encode().split() + [b" end"]


@pytest.mark.parametrize("slice_bytes", [4 << 20, 300])
def test_lm_against_exact_counts(spark, slice_bytes):
    """Long texts, repeated rows and columns with the output's names included. The base is exact, the score up to the filters' errors."""
    texts = TEXTS + [f"the cat {k % 4} sat on the mat {k}" for k in range(200)]
    rows = docs(spark, texts).withColumns({"score": F.lit("x"), "slice": F.lit("y"), "held_out": F.lit(3)})
    got = lm.score(rows, segments=5, slice_bytes=slice_bytes).collect()
    own = {k: words_of(t) for k, t in enumerate(texts)}
    out = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in own}
    model = Model([own[k] for k in [*own, 3] if not out[k]])  # a row is repeated
    assert len(got) == len(texts) + 1
    for r in got:
        w = own[r.doc_id]
        want = sum(math.log10((model.words[x] + 0.1) / (model.n + 0.1 * (model.v + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(w), sum(x in model.words for x in w), model.n)
        assert abs(r.base_score - want) < 1e-9 * max(1, abs(want)) and r.score <= 0
        assert abs(r.score - model.score(w)) <= 0.02 * abs(want) + 1e-6


def test_lm_sums_to_one():
    """Over all words and the unseen one, in contexts of every kind, within the bound that the levels leave."""
    rng = random.Random(4)
    draw = lambda: b"w%d" % int(400 * rng.random() ** 4)
    model = Model([[draw() for _ in range(60)] + [b" end"] for _ in range(400)])
    vocabulary = [*model.words, b"unseen"]
    contexts = [[], [b"w0"], [b"w399"], [b"unseen"], [b"w0", b"w0"], [b"w0", b"w1"], [b"w5", b"w9"], [b"unseen", b"w3"], [b"w3", b"unseen"]] + [[draw(), draw()] for _ in range(60)]
    sums = [sum(model.p(w, c) for w in vocabulary) for c in contexts]
    assert all(abs(x - 1) < lm.RATIO - 1 for x in sums) and abs(np.mean(sums) - 1) < 0.02
    assert abs(sums[0] - 1) < 1e-9 and abs(sums[3] - 1) < 1e-9


def test_lm_beats_base_on_held_out(spark):
    rng = random.Random(2)
    chain = {k: rng.sample(range(60), 4) for k in range(60)}

    def text():
        w, out = rng.randrange(60), []
        for _ in range(60):
            out.append(f"w{w}")
            w = rng.choice(chain[w])
        return " ".join(out)

    rows = [r for r in lm.score(docs(spark, [text() for _ in range(300)])).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.55 * sum(r.base_score for r in rows)


def test_filter_levels():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    counts = rng.integers(1, 300, len(h))
    f = lm.Filter.build(h[:15_000], counts[:15_000])
    got = f.look(h)
    assert (got[:15_000] >= lm.levels(counts[:15_000])).all()
    assert (got[:15_000] != lm.levels(counts[:15_000])).mean() < 0.03 and (got[15_000:] > 0).mean() < 0.03


def test_levels_are_near_their_counts():
    counts = np.concatenate([np.arange(1, 5000), 10 ** np.arange(4, 11)])
    ratio = lm.MEANS[lm.levels(counts)] / counts
    assert (ratio[:4] == 1).all() and ratio.min() > 1 / lm.RATIO**0.6 and ratio.max() < lm.RATIO**0.6


def test_sums_merge_as_they_come():
    rng, sums, want = np.random.default_rng(0), lm.Sums(), Counter()
    for _ in range(30):
        h = np.unique(rng.integers(0, 9000, 8000).astype(np.uint64))
        sums.add(h, np.full(len(h), 2))
        want.update({int(x): 2 for x in h})
    assert len(sums.new) < 30
    h, c = sums.merge()
    assert dict(zip(h.tolist(), c.tolist())) == want


# BPE
P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, library):
    texts = [*TEXTS, "<|endoftext|> don't we'll", "z" * 700, " " * 900 + "end", "word " * 3000]
    rows = docs(spark, texts).withColumns({"n_tokens": F.lit("x"), "ids": F.lit(1), "row": F.lit("y"), "nth": F.lit(0)})
    got = bpe.encode(rows.unionByName(rows.where("doc_id = 10")), VOCABULARY, P.PATTERN, ids=True, chunk=500, overlap=40)
    rows = got.collect()
    assert len(rows) == len(texts) + 2  # two rows are repeated, one of them long
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(got, VOCABULARY, P.PATTERN).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    assert bpe.encode(spark.createDataFrame([], SCHEMA), VOCABULARY, P.PATTERN).collect() == []


@given(st.lists(st.sampled_from(["a", "bc", " ", "  ", "\n", "'s", "'ll", "'", "1", "!", "é", "漢", "\x1c", "\x85", "😀", " "]), max_size=50), st.sampled_from([(3, 9), (9, 12), (17, 20)]))
@settings(max_examples=300, deadline=None)
def test_chunks_stitch(parts, size):
    known, text = bpe.codec(VOCABULARY, P.PATTERN), "".join(parts)
    got = [p for ps in bpe.stitch((c.tokenise(known.pattern) for c in bpe.chunks(text, *size)), known.pattern) for p in ps]
    assert got == known.pattern.findall(text)
