"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Each rule is a predicate over counts of a text, and owns what it counts: the count's expression
stands inside the rule's branch of the cascade, so a document that an earlier rule rejects never
pays for it. Only the number of words, which nearly all rules compare with, is counted before. A
bounded sample tells how long a rule takes from the text on, and how many documents it rejects;
rules then run in the order of rejections per second, and a rejected document skips the rules
behind.

The order decides only the running time: a document is kept if no rule rejects it, whatever
the order is. Defined cases: a null text has no words and fails ``few_words``; an empty table
gives an empty result; repeated rows each get their own row; other columns are carried through
``keep_clean`` and ignored by ``score``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm._common import WORD, let, words

#: Rows that estimates of cost and selectivity are taken from at most.
SAMPLE_ROWS = 2_000
#: Times that each rule is timed.
RUNS = 2
#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _windows(w: Column) -> Column:
    """Hashes of the 3-word windows of an array of words."""
    hashed = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.slice(hashed, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))


def _covered(h: Column) -> Column:
    """Words covered by the windows of ``h`` that occur twice or more: places are found by a sort, all steps are n log n at most."""

    def covered(s: Column) -> Column:
        same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        repeated = F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["p"]))
        steps = lambda at: F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1), p + 3) - p))
        return let(repeated, lambda at: F.aggregate(steps(at), F.lit(0), lambda a, x: a + x)).cast("long")

    return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), covered)


def _repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more. Windows are compared by 64-bit hash; only texts with a repeated one pay for the sort."""
    none = lambda h: F.size(F.array_distinct(h)) == F.size(h)
    return let(_windows(w), lambda h: F.when(none(h), F.lit(0).cast("long")).otherwise(_covered(h)))


def _repeats_more_than(w: Column, percent: int) -> Column:
    """Whether more than ``percent`` of the words are covered by repeated windows.

    A window that occurs c times has c - 1 repetitions, c is at most twice that, and a window covers
    three words: six times the repetitions bound the words covered, so most texts need no sort.
    """

    def more(h: Column) -> Column:
        least = percent * F.size(w)
        return F.when(600 * (F.size(h) - F.size(F.array_distinct(h))) <= least, F.lit(False)).otherwise(100 * _covered(h) > least)

    return let(_windows(w), more)


def _lines(text: Column) -> Column:
    """lines: those with a word; dup: those equal to an earlier one."""
    full = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(full, lambda x: F.struct(F.size(x).cast("long").alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))


def _removed(text: Column, pattern: str) -> Column:
    """Characters of a text that are in ``pattern``, a class."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))).cast("long")


SYMBOLS = "[#*$%&|<>]"


def statistics(text: Column) -> Column:
    """Struct of the counts that the base columns tell; all zero for null."""
    text = F.coalesce(text, F.lit(""))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _removed(text, SYMBOLS).alias("n_symbols"),
            _lines(text).alias("line"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )


class Counts:
    """The counts of a text, each an expression that is built when a rule asks for it; ``known`` ones are columns at hand."""

    def __init__(self, text: Column, **known: Column):
        self.text, self.known = F.coalesce(text, F.lit("")), known

    @property
    def n_words(self) -> Column:
        return self.known.get("n_words", F.regexp_count(self.text, F.lit(WORD)).cast("long"))

    @property
    def word_chars(self) -> Column:
        return self.known.get("word_chars", F.length(F.regexp_replace(self.text, r"[\x20\x09-\x0D]+", "")).cast("long"))

    @property
    def n_symbols(self) -> Column:
        return self.known.get("n_symbols", _removed(self.text, SYMBOLS))

    @property
    def line(self) -> Column:
        return self.known.get("line", _lines(self.text))

    def repeats_more_than(self, percent: int) -> Column:
        if "n_repeat_words" in self.known:
            return 100 * self.known["n_repeat_words"] > percent * self.n_words
        return let(words(self.text), lambda w: _repeats_more_than(w, percent))

    def chars_in(self, pattern: str) -> Column:
        """Characters in ``pattern``, a class."""
        return _removed(self.text, pattern)


@dataclass(frozen=True)
class Rule:
    """``rejects(counts)`` is true for a document that must go; ``base`` rules are the fixed ones."""

    name: str
    rejects: Callable[[Counts], Column]
    base: bool = False


RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda c: c.n_words < MIN_WORDS, base=True),
    Rule("repeated_windows", lambda c: c.repeats_more_than(MAX_REPEAT_PERCENT), base=True),
    Rule("symbols", lambda c: c.n_symbols > 0.25 * c.n_words),
    Rule("repeated_lines", lambda c: let(c.line, lambda x: x["dup"] > 0.5 * x["lines"])),
    Rule("long_words", lambda c: c.word_chars > 30 * c.n_words),
    Rule("exclamations", lambda c: c.chars_in("[!?]") > 0.5 * c.n_words),
    Rule("capitals", lambda c: c.chars_in(r"\p{Lu}") > 0.5 * c.word_chars),
)


@dataclass(frozen=True)
class Estimate:
    rule: str
    seconds: float
    rejected: float

    @property
    def rank(self) -> float:
        """Share rejected for each second."""
        return self.rejected / max(self.seconds, 1e-4)


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Cost and selectivity of each rule on at most ``sample_rows`` rows, best first.

    The sample is spread over the whole table by its row count. Each rule is timed alone, from
    the text on, as the best of ``RUNS`` jobs less the best without a rule.
    """
    total = docs.count()
    if not total:
        return [Estimate(r.name, 0.0, 0.0) for r in rules]
    sample = docs.sample(min(1.0, sample_rows / total), seed=7).limit(sample_rows).select("text").coalesce(4).cache()
    rows = max(1, sample.count())

    def timed(condition: Column) -> tuple[float, int]:
        took, hits = [], 0
        for _ in range(RUNS):
            began = time.perf_counter()
            hits = sample.agg(F.count_if(condition).alias("n")).first()["n"]
            took.append(time.perf_counter() - began)
        return min(took), hits

    idle, _ = timed(F.lit(False))
    found = []
    for rule in rules:
        seconds, hits = timed(cascade(F.col("text"), [rule]).isNotNull())
        found.append(Estimate(rule.name, max(seconds - idle, 1e-4), hits / rows))
    sample.unpersist()
    return sorted(found, key=lambda e: (-e.rank, e.rule))


def cascade(text: Column, rules: Sequence[Rule], **known: Column) -> Column:
    """Position of the first rule of ``rules`` that rejects, null if none; what later ones count is not evaluated."""
    counts, out = Counts(text, **known), None
    for k, rule in enumerate(rules):
        hit = F.coalesce(rule.rejects(counts), F.lit(True))
        out = F.when(hit, F.lit(k)) if out is None else out.when(hit, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def _ordered(docs: DataFrame, rules: Sequence[Rule], sample_rows: int) -> list[Rule]:
    by = {r.name: r for r in rules}
    return [by[e.rule] for e in estimate(docs, rules, sample_rows)]


def score(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base counts, ``base_failed`` and ``kept`` of every document.

    The base columns need their counts of every text; of the other rules only what the cascade
    reaches is counted, and nothing for documents that fail a base rule.
    """
    docs = docs.select("doc_id", "text")
    order = [r for r in _ordered(docs, rules, sample_rows) if not r.base]
    known = {n: F.col(f"s.{n}") for n in ("n_words", "word_chars", "n_symbols", "line", "n_repeat_words")}
    counts, failed = Counts(F.col("text"), **known), F.lit(False)
    for rule in rules:
        if rule.base:
            failed = failed | rule.rejects(counts)
    rows = docs.select("doc_id", "text", statistics(F.col("text")).alias("s")).withColumn("base_failed", failed)
    rows = rows.withColumn("kept", ~F.col("base_failed") & cascade(F.col("text"), order, **known).isNull())
    return rows.select("doc_id", "s.n_words", "s.word_chars", "s.n_symbols", F.col("s.line.dup").alias("n_dup_lines"), "s.n_repeat_words", "base_failed", "kept")


def keep_clean(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    order = _ordered(docs.select("text"), rules, sample_rows)
    rejected = let(Counts(F.col("text")).n_words, lambda n: cascade(F.col("text"), order, n_words=n))
    return docs.where(rejected.isNull())
