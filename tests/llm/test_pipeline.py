"""The pipeline's stages keep the columns, and what they decide takes effect."""

import base64
import hashlib
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from siftwork.llm import mixing, queries, secrets

from . import test_join, test_native

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, data):
    docs, seen = spark.read.parquet(f"{data}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data).cache()
        seen[name] = (docs, out)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == COLUMNS
            docs = out
    raw, clean = seen["quality_rules"]
    assert 0 < clean.count() < raw.count()
    before, after = seen["ngram_join"]
    assert after.count() == after.select("doc_id").distinct().count() <= before.count()
    before, after = seen["secret_scan"]
    assert before.count() == after.count() and after.where("n_chars <> length(text)").isEmpty()
    before, after = seen["source_mix"]
    words = lambda df: df.select(F.sum(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")))).first()[0]
    assert abs(words(after) / words(before) - 1.5) < 0.1
    docs, tokens = seen["byte_bpe"]
    assert tokens.count() == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in tokens.collect())


def rejected(text):
    """The quality rules by plain loops."""
    n, chars, symbols, dup, covered = test_native.brute(text)
    text = text or ""
    lines = [x for x in text.split("\n") if test_native.WORD.search(x)]
    upper = sum(c.isupper() for c in text)
    return n < 50 or 100 * covered > 50 * n or symbols > 0.25 * n or dup > 0.5 * len(lines) or chars > 30 * n or sum(c in "!?" for c in text) > 0.5 * n or upper > 0.5 * chars


def redacted(text, spans):
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


FURTHER = [re.compile(k.pattern) for k in secrets.KINDS if not k.base]


def test_stages_against_brute_force(spark, data):
    """Each stage on all that the one before kept: loops over all documents and pairs, Python's patterns, the tokenizer's library. Mixing is held to its targets."""
    library = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(corpus_pipeline.VOCABULARY, "rb"))}
    encoding = library.Encoding("own", pat_str=corpus_pipeline.PATTERN, mergeable_ranks=ranks, special_tokens={})
    stage = dict(corpus_pipeline.STAGES)
    long = " ".join(f"w{k}" for k in range(70))
    shared, live = "ghp_" + "Zz9x" * 10, "ghp_" + "a1B2" * 10
    more = [(9001, f"{long} token=abcdef123 {live}", "en", "s1", 1), (9002, f"{long} x", "en", "s1", 1), (9003, None, "en", None, 0), (9004, "", "en", "s1", 0), (None, " ".join(f"v{k}" for k in range(60)), "en", None, 1)]
    more += [(9010 + k, " ".join(f"{k}u{x}" for x in range(60)) + f" {shared}", "en", f"s{k}", 1) for k in range(3)]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).cache()
    text = {(r.doc_id, r.text): r for r in docs.collect()}

    clean = stage["quality_rules"](spark, docs, data).cache()
    kept = {(r.doc_id, r.text) for r in clean.collect()}
    assert kept == {k for k in text if not rejected(k[1])}

    one = stage["ngram_join"](spark, clean, data).cache()
    order = sorted(kept, key=lambda k: (k[0] is None, k[0] or 0))
    _, classes = test_join.brute({n: k[1] for n, k in enumerate(order)})
    firsts = {order[c] for c in classes.values()}
    assert {(r.doc_id, r.text) for r in one.collect()} == firsts

    safe = stage["secret_scan"](spark, one, data).cache()
    owners = {}
    for k in firsts:
        for p in FURTHER:
            for m in p.finditer(k[1]):
                owners.setdefault(m[0], set()).add(text[k].source)
    want = set()
    for k in firsts:
        spans = [(a, b) for a, _, b in test_native.spans(k[1])]
        spans += [m.span() for p in FURTHER for m in p.finditer(k[1]) if len(owners[m[0]]) < secrets.EXAMPLE_OWNERS]
        want.add((k[0], redacted(k[1], spans)))
    assert {(r.doc_id, r.text) for r in safe.collect()} == want and any("[SECRET]" in t for _, t in want) and any(shared in t for _, t in want)

    mixed = stage["source_mix"](spark, safe, data).cache()
    before, after, largest = Counter(), Counter(), Counter()
    for r in safe.collect():
        n = len(test_native.WORD.findall(r.text))
        before[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    for r in mixed.collect():
        after[r.source] += len(test_native.WORD.findall(r.text))
    targets = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(before.items()), "source string, source_size long")).collect()}
    assert all(abs(after[s] - targets[s]) <= largest[s] for s in before)

    tokens = stage["byte_bpe"](spark, mixed, data).collect()
    ids = lambda t: encoding.encode_ordinary(t or "")
    digest = lambda t: hashlib.sha256(" ".join(map(str, ids(t))).encode()).hexdigest()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in tokens) == Counter((r.doc_id, len(ids(r.text)), digest(r.text)) for r in mixed.collect())


def test_run_and_empty(spark, data, tmp_path):
    assert corpus_pipeline.run(spark, data).count() > 0
    spark.read.parquet(f"{data}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    table = {"op5": "conversations", "op6": "pages"}.get(name.split("_")[0], "documents")
    n = spark.read.parquet(f"{data}/{table}.parquet")
    want = n.select("conv_id").distinct().count() + 1 if table == "conversations" else n.count()
    assert df.count() == want
