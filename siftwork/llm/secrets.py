"""Secret scans with corpus-wide ownership frequency, with DataFrame functions only.

Base kinds are found by fixed patterns and always reported. Candidates of the further kinds are
hashed; for each hash the corpus tells in how many distinct repositories and for how many
distinct owners it occurs. A value that ``EXAMPLE_OWNERS`` owners share is a copied example, and so
is one that ``EXAMPLE_REPOSITORIES`` repositories hold, even of one owner. One that stays with few of
both looks live and is added to the spans. No table that is written holds a secret: values are
SHA-256 digests from where they are found on.

Positions are code points, ends are exclusive. Defined cases: a null text is empty and has no
spans; null owners and repositories count as one value of their own; repeated rows each keep
their row; equal starts are ordered by kind as listed; columns beyond doc_id, text and the owner
columns are ignored by ``scan`` and carried through ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm._common import let, materialize, workspace

#: Owners, and repositories, from which on a value counts as a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 20
#: Tasks that the spans of one value are dealt to when they meet its verdict.
SALTS = 8


@dataclass(frozen=True)
class Kind:
    """``value`` is the group that holds the secret; matches with a shorter value are dropped. Others than base kinds need the corpus's verdict."""

    name: str
    pattern: str
    value: int = 0
    least: int = 1
    base: bool = False


#: The base patterns. The lengths of access and hex can stand in the pattern, since a longer run can't start inside a failing one.
KINDS: tuple[Kind, ...] = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", value=2, least=6, base=True),
    Kind("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Kind("hex", r"[0-9a-f]{24,}", base=True),
    Kind("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}-----END [A-Z ]{0,30}PRIVATE KEY-----"),
    Kind("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Kind("prefixed", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})"),
)

SPAN = "array<struct<start:int,rank:int,end:int,value:binary>>"


def _spans(text: Column, kind: Kind, rank: int) -> Column:
    """Spans of one kind: what lies between the matches gives their places."""
    found = F.regexp_extract_all(text, F.lit(f"({kind.pattern})"), F.lit(1))
    secret = F.regexp_extract_all(text, F.lit(f"({kind.pattern})"), F.lit(kind.value + 1)) if kind.value else found
    parts = F.struct(F.split(text, kind.pattern).alias("gaps"), found.alias("found"), secret.alias("secret"))

    def placed(p: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(p["gaps"][i])
            end = start + F.length(p["found"][i])
            span = F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"), F.unhex(F.sha2(p["secret"][i], 256)).alias("value"))
            return F.struct(end.cast("int").alias("at"), F.when(F.length(p["secret"][i]) >= kind.least, F.concat(acc["out"], F.array(span).cast(SPAN))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(p["found"]) - 1), zero, step)["out"]

    return F.when(text.rlike(kind.pattern), let(parts, placed)).otherwise(F.array().cast(SPAN))


def _joined(spans: Column, kinds: tuple[Kind, ...]) -> Column:
    names = F.array(*[F.lit(k.name) for k in kinds])
    one = lambda x: F.concat_ws(":", names[x["rank"]], x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Every document with its base spans and its candidates, without its text; kept in the shared folder since two jobs read it."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    of = lambda base: F.flatten(F.array(*[_spans(text, k, i) for i, k in enumerate(kinds) if k.base == base]))
    rows = docs.select("doc_id", F.col(owner).alias("_owner"), F.col(repository).cast("string").alias("_repo"), F.col("text").alias("_text"))
    found = rows.select("doc_id", "_owner", "_repo", of(True).alias("base"), of(False).alias("more"), F.monotonically_increasing_id().alias("_row"))
    return materialize(found, workspace(docs.sparkSession, "secrets"))


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, repositories, owners: distinct ones over the whole corpus, for base spans and candidates.

    Counted in two steps, so that a value in a third of all documents is first reduced on each
    map side, then to one row for each of its owners and repositories.
    """
    hashed = found.select("_owner", "_repo", F.explode(F.concat("base", "more")).alias("x")).select("_owner", "_repo", F.col("x.value").alias("value_hash"))
    by_owner = hashed.groupBy("value_hash", "_owner").agg(F.lit(1).alias("one")).groupBy("value_hash").agg(F.count("one").alias("owners"))
    by_repo = hashed.groupBy("value_hash", "_repo").agg(F.lit(1).alias("one")).groupBy("value_hash").agg(F.count("one").alias("repositories"))
    return by_owner.join(by_repo, "value_hash")


def verdicts(found: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """``ownership`` with the verdict on each value: copied example or live."""
    copied = (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)
    return ownership(found).withColumn("verdict", F.when(copied, "example").otherwise("live"))


def _judged(each: DataFrame, judged: DataFrame, how: str = "inner") -> DataFrame:
    """``each`` with what ``judged`` (one row a value) says on its ``value_hash``; salted, as a third of all documents may hold one value."""
    spread = judged.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return each.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(spread, ["value_hash", "_salt"], how).drop("_salt")


def scan(
    docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, owner: str = "source", repository: str = "doc_id",
    example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES,
) -> DataFrame:
    """doc_id, all spans (base ones and live candidates) with their verdicts, for every document."""
    found = find(docs, kinds, owner, repository)
    judged = verdicts(found, example_owners, example_repositories).select("value_hash", "verdict")
    some = (F.size("base") > 0) | (F.size("more") > 0)
    plain = found.where(~some).select("doc_id", "base", F.array().cast(SPAN).alias("live"), F.lit(0).cast("long").alias("n_examples"), F.lit(0).cast("long").alias("n_live"))
    marked = lambda c, b: F.transform(c, lambda x: F.struct(x.alias("x"), F.lit(b).alias("b")))
    each = found.where(some).select("_row", "doc_id", "base", F.explode(F.concat(marked("base", True), marked("more", False))).alias("s"))
    each = _judged(each.withColumn("value_hash", F.col("s.x.value")), judged)
    live = F.col("verdict") == "live"
    with_spans = each.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("base").alias("base"),
        F.collect_list(F.when(live & ~F.col("s.b"), F.col("s.x"))).cast(SPAN).alias("live"),
        F.count_if(~live).alias("n_examples"), F.count_if(live).alias("n_live"),
    ).drop("_row")
    rows = plain.unionByName(with_spans)
    count = lambda rank: F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("long")
    counts = [count(i).alias(f"n_{k.name}") for i, k in enumerate(kinds) if k.base]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("base"), kinds), 256).alias("base_sha256"), _joined(F.concat("base", "live"), kinds).alias("spans"), "n_live", "n_examples")


def redact(
    docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, owner: str = "source", repository: str = "doc_id",
    example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES, mark: str = "[SECRET]",
) -> DataFrame:
    """The documents with every base span and every live candidate replaced by ``mark``.

    Values that many owners share are judged as in ``scan``. The texts are scanned once more for
    their places, so that only the few candidates' verdicts travel, not the texts: examples are
    the values to leave alone, looked up by a join only for documents that hold a candidate.
    """
    columns = docs.columns
    found = find(docs.select("doc_id", "text", *dict.fromkeys(c for c in (owner, repository) if c not in ("doc_id", "text"))), kinds, owner, repository)
    text = F.coalesce(F.col("text"), F.lit(""))
    of = lambda base: F.flatten(F.array(*[_spans(text, k, i) for i, k in enumerate(kinds) if k.base == base]))
    live = verdicts(found, example_owners, example_repositories).where("verdict = 'live'").select("value_hash")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"), F.col("text"), of(True).alias("_base"), of(False).alias("_more"))

    def cut(spans: Column, text: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            inside = x["start"] < acc["at"]
            piece = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark)))
            return F.struct(F.greatest(acc["at"], x["end"]).cast("int").alias("at"), piece.alias("out"))

        return F.aggregate(F.array_sort(spans), zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))

    def rebuilt(rows: DataFrame, spans: Column) -> DataFrame:
        new = F.when(F.size(spans) > 0, cut(spans, F.col("text"))).otherwise(F.col("text"))
        rows = rows.select("_doc", new.alias("_new"))
        made = {"text": F.col("_new"), "n_chars": F.length("_new").cast("long")}
        return rows.select(*[made[c].alias(c) if c in made else F.col(f"_doc.`{c}`").alias(c) for c in columns])

    plain = rebuilt(rows.where(F.size("_more") == 0), F.col("_base"))
    some = rows.where(F.size("_more") > 0).withColumn("_row", F.sha2(F.to_json("_doc"), 256))
    each = _judged(some.select("_row", F.explode("_more").alias("x")).distinct().withColumn("value_hash", F.col("x.value")), live, "left_semi")
    kept = each.groupBy("_row").agg(F.collect_list("x").cast(SPAN).alias("_live"))
    some = some.join(kept, "_row", "left")
    return plain.unionByName(rebuilt(some, F.concat("_base", F.coalesce("_live", F.array().cast(SPAN)))))
