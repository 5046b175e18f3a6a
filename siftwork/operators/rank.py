"""Relevance ranking of source candidates and diversified top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.functions import text, urls

#: Words that don't tell anything about a topic, weights, boosts, cut and the penalty of a further pick from one domain.
STOP_WORDS = ("a", "an", "and", "are", "for", "from", "in", "of", "on", "or", "the", "to", "with", "find", "list", "data", "information")
TITLE, SNIPPET, URL, PHRASE, PREFERRED, LEAST, PENALTY = 0.55, 0.30, 0.15, 0.25, 0.15, 0.12, 0.08
#: Scores are compared in millionths, free of rounding noise.
SCALE = 1_000_000


def query_terms(queries: list[str]) -> list[str]:
    """Distinct terms of the queries in order; the driver's side of the tokeniser."""
    import re
    import unicodedata

    out: dict[str, None] = {}
    for q in queries:
        plain = "".join(c for c in unicodedata.normalize("NFKD", q) if not "̀" <= c <= "ͯ").lower()
        out |= dict.fromkeys(w for w in re.split(r"[\W_]+", plain) if len(w) > 1 and w not in STOP_WORDS)
    return list(out)


def coverage(terms: list[str], words: Column) -> Column:
    """Share of the terms among the words."""
    return F.size(F.array_intersect(F.array(*[F.lit(t) for t in terms]), words)) / F.lit(float(len(terms)))


def score(terms: list[str], preferred: list[str] = ()) -> Column:
    """Relevance of a candidate (title, snippet, url), 0 to 1."""
    words = lambda c: text.tokens(F.coalesce(F.col(c), F.lit("")), STOP_WORDS)
    phrase = F.when(text.fold(F.coalesce("title", F.lit(""))).contains(" ".join(terms)), PHRASE).otherwise(0.0) if len(terms) > 1 else F.lit(0.0)
    hosts = [urls.rule_host(p).removeprefix("www.") for p in preferred]
    liked = F.when(F.coalesce(urls.matches_rules(urls.bare_host(F.col("url")), hosts), F.lit(False)), PREFERRED).otherwise(0.0)
    return F.least(F.lit(1.0), coverage(terms, words("title")) * TITLE + coverage(terms, words("snippet")) * SNIPPET + coverage(terms, words("url")) * URL + phrase + liked)


def best_by_url(candidates: DataFrame, terms: list[str], preferred: list[str] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """idx, canonical, domain, points (score in millionths) of the best candidate of each page, above the cut; columns ``by`` part the candidates into lists of their own.

    Reduced by ``max_by`` before the shuffle: pages with many candidates need no window.
    """
    rows = candidates.select(*by, "idx", urls.ranking_form(F.col("url")).alias("canonical"), urls.bare_host(F.col("url")).alias("domain"), F.round(score(terms, preferred) * SCALE).cast("long").alias("points"))
    rows = rows.where(F.col("canonical").isNotNull() & (F.col("points") >= int(LEAST * SCALE)))
    return rows.groupBy(*by, "canonical").agg(F.max(F.struct("points", (-F.col("idx")).alias("at"), "domain")).alias("m")).select(*by, (-F.col("m.at")).alias("idx"), "canonical", F.col("m.domain").alias("domain"), F.col("m.points").alias("points"))


def diversified(ranked: DataFrame, limit: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Greedy top-k in which each pick lowers its domain's others by a penalty.

    Within a domain picks go by score, so a candidate's adjusted score is its own less the penalty
    for its rank there, and the greedy choice is the top-k of the adjusted scores. No candidate
    beyond a domain's first ``limit`` can be chosen, so the ranks come from a pruned window.
    """
    w = W.partitionBy(*by, "domain").orderBy(F.desc("points"), "idx")
    rows = ranked.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= limit)
    rows = rows.withColumn("adjusted", F.col("points") - int(PENALTY * SCALE) * (F.col("_rank") - 1)).drop("_rank")
    return _first(rows, limit, by, F.desc("adjusted"), F.desc("points"), "idx")


def _first(rows: DataFrame, limit: int, by: tuple[str, ...], *order: Column | str) -> DataFrame:
    """The first ``limit`` rows, or those of each list."""
    if not by:
        return rows.orderBy(*order).limit(limit)
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= limit).drop("_rank")


def rank(candidates: DataFrame, queries: list[str], limit: int, preferred: list[str] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """The chosen candidates by score: idx, canonical, domain, points, adjusted. Without query terms the first ones in order.

    Columns ``by`` part the candidates into lists that rank apart, each with its own ``limit``.
    """
    terms = query_terms(queries)
    if limit <= 0 or not terms:
        plain = candidates.select(*by, "idx", urls.ranking_form(F.col("url")).alias("canonical"), urls.bare_host(F.col("url")).alias("domain"), F.lit(0).cast("long").alias("points"), F.lit(0).cast("long").alias("adjusted"))
        return _first(plain, max(limit, 0), by, "idx")
    return diversified(best_by_url(candidates, terms, preferred, by), limit, by).orderBy(*by, F.desc("points"), "idx")
