"""Packing, repair of conversations and collocations against brute force, with their defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest

from siftwork.llm import collocation, packing, repair

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def holds(histogram, window):
    """The plan keeps each document's ids once, sequences without holes, and pads nothing; number of pieces."""
    p = packing.plan(histogram, window)
    lengths = np.concatenate([np.full(n, x, np.int64) for x, n in histogram.items()] or [np.zeros(0, np.int64)])
    ranks = np.concatenate([np.arange(n) for n in histogram.values()] or [np.zeros(0, np.int64)]).astype(np.int64)
    if not len(lengths):
        return 0
    documents, sequences = defaultdict(list), defaultdict(list)
    for row, start, size, sequence, offset in zip(*(c.tolist() for c in p.place(lengths, ranks))):
        documents[row].append((start, size))
        sequences[sequence].append((offset, size))
    for of, size in [(documents[k], x) for k, x in enumerate(lengths.tolist())] + [(v, None) for v in sequences.values()]:
        at = 0
        for start, n in sorted(of):
            assert start == at and n > 0
            at += n
        assert at == size if size is not None else at == window or (at < window and not at & (at - 1))
    assert sorted(sequences) == list(range(len(sequences)))
    return sum(map(len, documents.values()))


def test_plan():
    rng = random.Random(5)
    for window in (64, 4096):
        for _ in range(25):
            top = rng.choice([3, 40, window])
            holds(Counter(rng.randint(1, min(top, window)) for _ in range(rng.randint(0, 200))), window)
    assert holds({n: 50 for n in range(1, 4097)}, 4096) == 50 * 4096  # exact sums exist for all: nothing is cut
    holds({3000: 20_000}, 4096)
    assert len(packing.plan({n: 10**9 for n in range(1, 257)}, 256).key) < 2_000  # as many entries as patterns, not documents


def test_fill_is_best():
    rng = random.Random(6)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(0, 6))}
        room = rng.randint(0, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        got = packing.fill(counts, room)
        assert all(n <= counts[x] for x, n in got.items()) and sum(x * n for x, n in got.items()) == max(s for s in sums if s <= room)


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_pack(spark):
    rng = random.Random(7)
    marks = [" ", "\t", "\n\n", " ", " ", "'s ", " é", "́", "İ", "ß", "一", "\U0001f600", "<|endoftext|>", "it's", "12", "!?", "x" * 200]
    rows = [(k, "".join(rng.choice(marks) for _ in range(rng.randint(0, 300)))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, "no id"), (5, "same"), (5, "same"), (203, "long words " * 3000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, bucket int").repartition(5)
    got = packing.pack(docs, TOKENIZER, window=256).collect()
    want = Counter((i, tuple(ids_of(t))) for i, t in rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        pieces[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id in {i for i, _ in rows} - {5}:
        whole = [x for _, ids, _ in sorted(pieces[doc_id]) for x in ids]
        assert want[(doc_id, tuple(whole))] == 1 and {n for *_, n in pieces[doc_id]} == {len(whole)}
    assert Counter(x for _, ids, _ in pieces[5] for x in ids) == Counter(x for i, t in rows if i == 5 for x in ids_of(t))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)]).tolist()
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and (ends[-1] == 256 or ends[-1] & (ends[-1] - 1) == 0)
    whole = packing.sequences(packing.pack(docs, TOKENIZER, window=256)).collect()
    assert sum(r["n_tokens"] for r in whole) == sum(len(ids) * n for (_, ids), n in want.items()) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in whole)
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


def cheapest(symbols):
    """(cost, audit) by trying all edits."""

    @lru_cache(None)
    def best(i, state, inserts):
        ways = [(0, "")] if i == len(symbols) and state in repair.SOUND else []
        if i < len(symbols):
            for edit, cost, to in repair.edits(state, symbols[i]):
                rest = best(i + 1, to, 3)
                ways.append((cost + rest[0], edit + rest[1]))
        if inserts:
            rest = best(i, repair.AFTER[state, repair.NEXT[state]], inserts - 1)
            ways.append((repair.INSERT + rest[0], "I" + rest[1]))
        return min(ways, default=(10**9, ""))

    return best(0, 0, 3)


def test_tables():
    t, rng = repair.tables(), random.Random(8)
    assert len(t.vectors) < 64
    for _ in range(3_000):
        symbols = bytes(rng.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8]) for _ in range(rng.randint(0, 11)))
        to, added = t.through(symbols)
        v = to[t.end]
        audit, state = t.trace(symbols, t.behind(symbols, t.end), 0, True)
        assert (t.end_cost + added[t.end] + t.vectors[v][0], audit) == cheapest(symbols) and state in repair.SOUND


def by_hand(rows):
    """The whole of operator 12 in loops, for rows (conv_id, turn, role, text)."""
    damaged = defaultdict(list)
    for conv, turn, role, text in rows:
        damaged[conv] += []
        one = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if fault:
            text = "" if fault == 1 else re.sub(r"[.!?]", "", text) if fault == 2 else text
            damaged[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = set()
    for conv, held in damaged.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, symbols, counts = set(), [], Counter()
        for _, role, text in held:
            last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            initial = "sua".find(role[:1]) if role else 3
            symbols.append(8 if fault in ("blank", "duplicate") else (3 if initial < 0 else initial) + 4 * (fault == "truncated"))
        cost, audit = cheapest(tuple(symbols))
        rest, lines, state = iter(held), [], 0
        for edit in audit:
            _, role, text = next(rest) if edit != "I" else (0, "", "")
            if edit == "D":
                continue
            initial = role[:1] if edit == "K" else repair.NEXT[state]
            state = repair.AFTER[state, initial]
            lines.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[initial]}:{text}")
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        out.add((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_repair(spark, hot):
    rng = random.Random(9)
    roles, texts = ["user", "assistant", "system", "", "User", "tool", None, "assistant", "user"], ["Yes.", "No", " ", "", None, "Why?\n", "What ", "ok .x", "é!", "Yes."]
    rows = [(None if c == 3 else c, rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts)) for c in range(120) for _ in range(rng.randint(1, 9))]
    if hot:  # one conversation in many ranges
        rows += [(7, k, rng.choice(roles[:3]), rng.choice(["Yes.", f"{k}.", f"{k}"])) for k in range(300)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string").repartition(3)
    if hot:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = repair.damaged_and_repaired(table).collect()
        turns = repair.repaired(repair.damage(table)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == by_hand(rows)
    lines = defaultdict(list)
    for r in sorted(turns, key=lambda r: r["n"]):
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    digests = {r["conv_id"]: r["repaired_sha256"] for r in got}
    assert all(hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() == d for c, d in digests.items())
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in said)) for said in lines.values())
    assert repair.damaged_and_repaired(table.limit(0)).count() == 0


def test_transducers():
    rng = random.Random(10)
    words = "a b c ab ba é".split()
    several = [Counter(tuple(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(200)) for _ in range(5)]
    parts = [collocation.Transducer.of(sorted(c.items())) for c in several]
    for t, c in zip(parts, several):
        assert list(t.phrases()) == sorted(c.items()) and list(collocation.Transducer.read(*t.row().values()).phrases()) == sorted(c.items())
    total = sum(several, Counter())
    assert list(collocation.union(parts, 4).phrases()) == sorted((p, n) for p, n in total.items() if n >= 4)
    asked = sorted({tuple(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(50)})
    acceptor = collocation.Transducer.of((p, 1) for p in asked)
    assert sorted(collocation.union(parts).composed(acceptor)) == [(p, total[p]) for p in asked if p in total]
    alike = collocation.Transducer.of([((a, b, "x"), 1) for a in "pqr" for b in "stu"])
    assert len(alike.weights) == 4  # equal ends are one state


def phrases(docs, least, top):
    """Operator 13 in loops, for rows (text, lang)."""
    lower = {k: k + 32 for k in range(65, 91)}
    counts, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            counts[lang].update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * c[p[i : i + k]]}
        rows = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, r[2].decode(), -r[1], r[3], r[4], n[lang], -r[0]) for i, r in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def test_collocations(spark, monkeypatch):
    monkeypatch.setattr(collocation, "SHARD", 3_000)  # many shards and unions in tasks of this process's forks
    monkeypatch.setattr(collocation, "UNITED", 3)
    rng = random.Random(11)
    words = ["a", "B", "b", "c", "é", "zz", "x y", "\U0001f600", '"q"', "ß"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "\t", "  ", " ", " ", ". ", "\n", ";", "\x0b"]) for _ in range(n))
    rows = [(text(rng.randint(0, 200)), rng.choice(["en", None, "de"])) for _ in range(150)] + [(None, "en"), ("", "fr"), ("Same same.", "es"), (text(6_000), "en")] + [("Same same.", "es")] * 30
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, word int, shard string").repartition(6)
    for least, top in ((3, 40), (30, 2000)):
        assert sorted(map(tuple, collocation.mine(docs, least, top).collect())) == phrases(rows, least, top)
    assert collocation.mine(docs.limit(0)).count() == 0


def test_exact_scores(spark):
    """Products beyond 64 bits: 1000 a n over l r with counts of 10 ** 13."""
    a, n, l, r = 10**13 - 7, 10**14 - 3, 10**13 - 1, 10**13 - 3
    got = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long").selectExpr(f"{collocation.SCORE} AS score").first()["score"]
    assert got == 1000 * a * n // (l * r)
