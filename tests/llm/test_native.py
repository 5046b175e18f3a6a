"""Quality rules, mixing and secret scans against brute force, on texts of every awkward kind."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftwork.llm import _common, mixing, quality, secrets, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_words string, kept int"
LONG = " ".join(f"w{k % 4001}" for k in range(60_000))
TEXTS = [
    None, "", " \t\n", "one", "a b c a b c", "a a a a", "x\ny\nx\n\n \nx", "é ü 漢字 # $ %", " ".join(f"word{k}" for k in range(80)), " ".join(["same three words"] * 40), "LOUD!! " * 60, "### " * 60, LONG,
    "zero width one word", "line one two three\n" * 30,
]


def docs(spark, texts=TEXTS):
    rows = [(k, t, None if k % 5 == 4 else f"s{k % 3}", "clash", 7) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[5:7], SCHEMA)


def brute(text):
    w = WORD.findall(text or "")
    often = Counter(zip(w, w[1:], w[2:]))
    covered = {k + d for k in range(len(w) - 2) if often[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_base(spark):
    got = quality.score(docs(spark)).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        n = brute(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, r.doc_id
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.base_failed and r.kept)


def test_quality_keeps_clean_and_all_columns(spark):
    kept = quality.keep_clean(docs(spark))
    assert kept.columns == ["doc_id", "text", "source", "n_words", "kept"]
    assert {r.doc_id for r in kept.collect()} == {8}
    assert {r.doc_id for r in quality.score(docs(spark)).where("kept").collect()} == {8}


def test_cascade_order_changes_nothing(spark):
    a = quality.score(docs(spark), rules=quality.RULES[::-1]).select("doc_id", "kept").collect()
    b = quality.score(docs(spark)).select("doc_id", "kept").collect()
    assert sorted(a) == sorted(b)
    estimates = quality.estimate(docs(spark))
    assert [e.rank for e in estimates] == sorted((e.rank for e in estimates), reverse=True)


def test_cascade_spares_later_rules(spark):
    """A rule behind one that rejects is not evaluated: here its count would raise an error."""
    few = next(r for r in quality.RULES if r.name == "few_words")
    bomb = quality.Rule("bomb", lambda c: F.when(c.n_words < quality.MIN_WORDS, F.raise_error(F.lit("evaluated")).cast("boolean")).otherwise(F.lit(False)))
    rows = docs(spark)
    kept = lambda rules: rows.where(quality.let(quality.Counts(F.col("text")).n_words, lambda n: quality.cascade(F.col("text"), rules, n_words=n)).isNull()).count()
    assert kept([few, bomb]) == sum(len(WORD.findall(rows_ or "")) >= quality.MIN_WORDS for rows_ in TEXTS + TEXTS[5:7])
    with pytest.raises(Exception, match="evaluated"):
        kept([bomb, few])


def test_every_rule_with_counts_at_hand_and_without(spark):
    """A rule says the same from the text as from known counts, and as in Python."""
    known = {n: F.col(f"s.{n}") for n in ("n_words", "word_chars", "n_symbols", "line", "n_repeat_words")}
    texts = [*TEXTS, "a b c " * 20 + " ".join(f"w{k}" for k in range(60)), "a b c d " * 30, "AB cd " * 40]
    rows = docs(spark, texts).select("doc_id", "text", quality.statistics(F.col("text")).alias("s"))
    flags = [F.coalesce(r.rejects(quality.Counts(F.col("text"), **k)), F.lit(True)).alias(f"{r.name}_{x}") for x, k in enumerate(({}, known)) for r in quality.RULES]
    for r in rows.select("doc_id", *flags).collect():
        n, chars, symbols, dup, covered = brute(texts[r.doc_id])
        text = texts[r.doc_id] or ""
        lines = [x for x in text.split("\n") if WORD.search(x)]
        upper = sum(c.isupper() for c in text)
        want = {"few_words": n < 50, "repeated_windows": 100 * covered > 50 * n, "symbols": symbols > 0.25 * n, "repeated_lines": dup > 0.5 * len(lines), "long_words": chars > 30 * n, "exclamations": sum(c in "!?" for c in text) > 0.5 * n, "capitals": upper > 0.5 * chars}
        assert {k: (r[f"{k}_0"], r[f"{k}_1"]) for k in want} == {k: (v, v) for k, v in want.items()}, r.doc_id


@pytest.mark.parametrize("run", [quality.score, quality.keep_clean, mixing.plan, mixing.mix, secrets.scan, secrets.redact])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []


BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24),
)
KEY = "AKIA" + "Q" * 18
LIVE, SHARED = "ghp_" + "a1B2" * 10, "ghp_" + "Zz9x" * 10
SECRETS = [
    None, "", "no secrets", 'é 漢 token = "abcdef123"', "password: token: abcdef", "PASSWD='short' secret=longenough", f"{KEY} and AKIAshort {KEY}x", "0123456789abcdef01234567 0123", f"a {LIVE} b", f"x {SHARED}", f"y {SHARED}", f"{SHARED} z",
    "api_key:aaaaaa api-key:bbbbbb apikey=cccccc", "x " * 20_000 + "token=lastsecret", "-----BEGIN PRIVATE KEY-----\nabcdefghijklmnopqrst\n-----END PRIVATE KEY-----",
]


def spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, group, least) in enumerate(BASE) for m in p.finditer(text or "") if len(m[group]) >= least]
    return sorted(found)


def test_secret_spans(spark):
    got = secrets.scan(docs(spark, SECRETS)).collect()
    assert len(got) == len(SECRETS) + 2
    for r in got:
        base = spans(SECRETS[r.doc_id])
        text = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    by = {r.doc_id: r.spans for r in got}
    assert by[8] == "prefixed:2:46" and by[14].startswith("private_key:0:")
    assert "prefixed" not in by[9] + by[10] + by[11]  # three owners share it: an example


def test_many_repositories_of_one_owner_are_an_example(spark):
    """A value that an owner copies to many repositories is none of its live ones."""
    few, many_ = "ghp_" + "Kk1" * 13, "ghp_" + "Qq2" * 13
    rows = [(k, f"here {many_}", "one", "x", 1) for k in range(secrets.EXAMPLE_REPOSITORIES)] + [(1000 + k, f"here {few}", "one", "x", 1) for k in range(secrets.EXAMPLE_REPOSITORIES - 1)]
    got = secrets.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.doc_id >= 1000, r.spans, r.n_live, r.n_examples) for r in got} == {(False, "", 0, 1), (True, "prefixed:5:48", 1, 0)}


def test_no_secret_is_written(spark):
    """What is kept in the shared folder are digests."""
    found = secrets.find(docs(spark, SECRETS))
    assert LIVE not in repr(found.collect())


def test_hot_value(spark):
    """A value in a third of all documents gets its verdict in each of them."""
    rows = [(k, f"token={'h' * 9 if k % 3 == 0 else f'value{k}x'}", f"s{k % 5}", "x", 1) for k in range(300)]
    got = secrets.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.n_examples for r in got) == 100 and sum(r.n_live for r in got) == 200


def test_ownership_counts(spark):
    found = secrets.find(docs(spark, SECRETS))
    owners, repos = defaultdict(set), defaultdict(set)
    for r in found.collect():
        for x in [*r.base, *r.more]:
            h = bytes(x.value)
            owners[h].add(r._owner)
            repos[h].add(r._repo)
    got = {bytes(r.value_hash): (r.owners, r.repositories) for r in secrets.ownership(found).collect()}
    assert hashlib.sha256(LIVE.encode()).digest() in got
    # a null owner counts as one value of its own
    assert got == {h: (len(owners[h]), len(repos[h])) for h in owners}


def test_redaction(spark):
    got = {r.doc_id: r for r in secrets.redact(docs(spark, SECRETS)).collect()}
    assert set(got[3].asDict()) == {"doc_id", "text", "source", "n_words", "kept"}
    assert got[0].text is None and got[2].text == "no secrets"
    assert got[3].text == 'é 漢 [SECRET]"' and got[8].text == "a [SECRET] b" and SHARED in got[9].text
    assert all(not spans(r.text) for r in got.values())


def test_mixing_targets(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, None: 50, "d": 500}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    names = [*sorted(x for x in sizes if x), None]
    weight, cap, total = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, {s: 2.0 * sizes[s] for s in names}, 1.5 * sum(sizes.values())
    fixed = {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap[s]]
        if not over:
            break
        fixed |= {s: cap[s] for s in over}
    want = fixed | share
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in rows) and abs(sum(r.target for r in rows) - total) < 1e-6


def many(spark):
    """One source with a third of all rows, sizes with a long tail, repeated rows and words-less texts."""
    rows = []
    for k in range(1500):
        n = 0 if k % 97 == 0 else 5 + (k * 7919) % 60 + (400 if k % 50 == 0 else 0)
        rows.append((k, " ".join(["w"] * n) if k % 211 else None, "hot" if k % 3 == 0 else f"s{k % 7}" if k % 11 else None, "x", 1))
    return spark.createDataFrame(rows + rows[:40], SCHEMA)


def test_mix_is_near_its_targets(spark):
    df = many(spark)
    got = mixing.plan(df).collect()
    assert len(got) == 1540
    size = {r.doc_id: len((r.text or "").split()) for r in df.collect()}
    source = {r.doc_id: r.source for r in df.collect()}
    taken, target, largest = Counter(), {}, Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 2 * r.size
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r.size)
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s], (s, taken[s], target[s])
    assert sorted(mixing.plan(df).collect()) == sorted(got)


def as_split(spark, tmp_path, df, run, sort):
    """Rows of ``run`` over one table read at two split sizes and from two writings of its files."""
    out = []
    for k, (files, split) in enumerate(((1, "128m"), (7, "4k"))):
        df.repartition(files).write.parquet(f"{tmp_path}/{k}")
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            out.append(sorted(run(spark.read.parquet(f"{tmp_path}/{k}")).collect(), key=sort))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    return out


@pytest.mark.parametrize("run", [mixing.plan, mixing.mix, sharding.shard])
def test_results_do_not_depend_on_splits(spark, tmp_path, run):
    one, other = as_split(spark, tmp_path, many(spark), run, repr)
    assert one == other


def test_targets_of_many_sources(spark):
    """A source a document; caps and shares as in the loop over sources."""
    rows = spark.range(2000).select(F.concat(F.lit("s"), "id").alias("source"), (F.col("id") % 50 * F.col("id")).alias("source_size"))
    sizes = {r.source: r.source_size for r in rows.collect()}
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}
    level, full = 0.0, set()
    while True:
        level = (1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        now = {s for s in sizes if 2 * sizes[s] <= weight[s] * level}
        if now == full:
            break
        full = now
    assert all(abs(got[s] - min(2 * sizes[s], weight[s] * level)) < 1e-6 for s in sizes)


def test_row_repeated_many_times(spark, monkeypatch):
    """More copies of a row than one task unrolls."""
    monkeypatch.setattr(_common, "UNROLLED", 7)
    df = spark.range(100).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    got = mixing.plan(df).collect()
    assert len(got) == 100 and abs(sum(r.taken for r in got) - 450) <= 3
    assert mixing.mix(df).count() == sum(r.copies for r in got)
    assert sorted(r["slot"] for r in sharding.shard(df, 1).collect()) == list(range(100))


def test_mix_repeats_rows(spark):
    df = many(spark).repartition(1)
    out = mixing.mix(df)
    assert out.columns == df.columns
    words = out.select(F.sum(F.size(F.split("text", " "))).alias("n")).first().n
    assert abs(words - 1.5 * df.select(F.sum(F.size(F.split("text", " ")))).first()[0]) < 0.02 * words


def test_pivotal_keeps_expectations(spark):
    items = spark.range(40).select(F.lit("s").alias("source"), F.col("id").alias("row"), (F.col("id") % 4 + 1).alias("size"), F.lit(0.3).alias("p"))
    from siftwork.llm._common import workspace

    hits = Counter()
    for seed in range(6):
        rows = mixing.pivotal(items, workspace(spark, "pivot"), seed * 100).collect()
        assert len(rows) == 40 and {r.p for r in rows} <= {0.0, 1.0}
        assert abs(sum(r.p * r.size for r in rows) - 30) <= 4
        hits.update(int(r.p) for r in rows)
    assert 0.2 < hits[1] / 240 < 0.4
