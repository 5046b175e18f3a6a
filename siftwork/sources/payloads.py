"""Readers of tool output: loosely shaped JSON texts become rows, by path expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import urls

#: The lists of a search result and the levels they may stand at.
CATEGORIES, LEVELS = ("web", "news", "images"), ("$", "$.data")
ARRAY = "array<string>"


def json_text(c: Column) -> Column:
    """The text if it looks like JSON and is, else null."""
    looks = F.trim(c).rlike(r"^[\[{]")
    return F.when(looks & F.try_parse_json(c).isNotNull(), c)


def coerced(c: Column) -> Column:
    """JSON of a field that may be JSON as a text: the inner document where it is one."""
    inner = F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")
    return F.coalesce(json_text(inner), c)


def get(c: Column, *paths: str) -> Column:
    """First path that holds something."""
    return F.coalesce(*[F.get_json_object(c, p) for p in paths])


def items(c: Column, path: str) -> Column:
    """Array at a path as JSON texts; empty if there is none."""
    found = F.get_json_object(c, path) if path != "$" else c
    return F.coalesce(F.from_json(F.when(F.trim(found).startswith("["), found), ARRAY), F.array().cast(ARRAY))


def records(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """id, pos, values (map of texts), source_urls of ``records[]``; bad JSON and records without values give none."""
    each = payloads.select("id", F.posexplode(items(json_text(F.col(text)), "$.records")).alias("pos", "r"))
    values = F.from_json(F.get_json_object("r", "$.values"), "map<string,string>")
    own = F.coalesce(F.from_json(F.get_json_object("r", "$.sourceUrls"), ARRAY), F.array().cast(ARRAY))
    return each.select("id", "pos", values.alias("values"), own.alias("source_urls")).where(F.size("values") > 0)


def _row(c: Column, category: str | None) -> Column:
    answer = get(c, "$.answer")
    return F.struct(
        F.lit(category).cast("string").alias("category"), get(c, "$.url", "$.imageUrl").alias("url"), get(c, "$.title").alias("title"), F.coalesce(get(c, "$.description", "$.snippet"), answer, F.lit("")).alias("description"),
        F.coalesce(get(c, "$.markdown"), answer).alias("markdown"), answer.alias("answer"), get(c, "$.favicon", "$.metadata.favicon").alias("favicon"), get(c, "$.date").alias("date"), get(c, "$.imageUrl").alias("image_url"),
        get(c, "$.position").try_cast("double").alias("position"),
    )


def _all_rows(text: Column) -> Column:
    """Rows of all lists of a search result, with or without url and title."""
    c = json_text(text)
    of = lambda path, category: F.transform(items(c, path), lambda x: _row(x, category))
    lists = [of(f"{level}.{k}", k) for level in LEVELS for k in CATEGORIES] + [of(f"{level}.results", None) for level in LEVELS] + [of("$", None)]
    return F.concat(*lists)


def hits(text: Column) -> Column:
    """Array of the rows of a search result that have a url or a title."""
    return F.filter(_all_rows(text), lambda r: r["url"].isNotNull() | r["title"].isNotNull())


def search_rows(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """id, pos and the rows of a search result: named lists at either level, ``results``, or a bare array; rows without url and title are dropped."""
    each = payloads.select("id", F.posexplode(_all_rows(F.col(text))).alias("pos", "r"))
    return each.select("id", "pos", "r.*").where(F.col("url").isNotNull() | F.col("title").isNotNull()).withColumns({"title": F.coalesce("title", F.lit("")), "url": F.coalesce("url", F.lit(""))})


def page_rows(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """id and the parts of a page result, each from its first place."""
    c = json_text(F.col(text))
    links = F.when(F.size(items(c, "$.links")) > 0, items(c, "$.links")).otherwise(items(c, "$.data.links"))
    target = lambda x: F.when(F.trim(x).startswith("{"), F.get_json_object(x, "$.url")).otherwise(x)
    meta = lambda k: get(c, f"$.metadata.{k}", f"$.data.metadata.{k}")
    return payloads.select(
        "id", get(c, "$.url", "$.data.url").alias("url"), F.coalesce(get(c, "$.markdown", "$.content", "$.data.markdown"), F.lit("")).alias("markdown"),
        get(c, "$.json", "$.data.json", "$.extract", "$.data.extract").alias("json"), get(c, "$.answer", "$.data.answer").alias("answer"), F.coalesce(meta("title"), meta("ogTitle")).alias("title"),
        F.coalesce(meta("description"), meta("ogDescription")).alias("description"), meta("language").alias("language"), F.coalesce(meta("statusCode"), get(c, "$.statusCode")).try_cast("int").alias("status"),
        F.filter(F.transform(links, target), lambda x: F.coalesce(x != "", F.lit(False))).alias("links"), get(c, "$.error").alias("error"),
    )


def load_rows(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """id, pos, url, file and state (loaded, empty, error) of the pages that a shell loaded."""
    c = json_text(F.col(text))
    each = payloads.select("id", F.posexplode(F.concat(items(c, "$.pages"), items(c, "$.data.pages"))).alias("pos", "p"))
    size = F.coalesce(get(F.col("p"), "$.bytes", "$.size").try_cast("long"), F.length(get(F.col("p"), "$.content")).cast("long"), F.lit(0).cast("long"))
    state = F.when(get(F.col("p"), "$.error").isNotNull(), "error").when(size > 0, "loaded").otherwise("empty")
    return each.select("id", "pos", get(F.col("p"), "$.url").alias("url"), get(F.col("p"), "$.file", "$.path").alias("file"), state.alias("state"))


def exec_rows(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """id, output, errors and exit code of a shell command."""
    c = json_text(F.col(text))
    return payloads.select("id", F.coalesce(get(c, "$.stdout", "$.output"), F.lit("")).alias("stdout"), F.coalesce(get(c, "$.stderr"), F.lit("")).alias("stderr"), F.coalesce(get(c, "$.exitCode", "$.exit_code").try_cast("int"), F.lit(0)).alias("exit_code"))


def missing_paths(c: Column, paths: list[str]) -> Column:
    """Dotted paths that a JSON text lacks or holds null at, in order."""
    return F.array_compact(F.array(*[F.when(F.get_json_object(c, f"$.{p}").isNull(), F.lit(p)) for p in paths]))


def extra_keys(c: Column, keys: list[str]) -> Column:
    """Top-level keys of a JSON text beyond ``keys``."""
    return F.array_except(F.coalesce(F.json_object_keys(c), F.array().cast(ARRAY)), F.array(*[F.lit(k) for k in keys]).cast(ARRAY))


def collect_sources(found: DataFrame) -> DataFrame:
    """One row a page of ``found`` (run, seq, url, title): the first, but with the first title that there is."""
    rows = found.withColumn("canonical_url", urls.source_form(F.col("url"))).where("canonical_url is not null")
    titled = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.struct("seq", "title"))
    return rows.groupBy("run", "canonical_url").agg(F.min("seq").alias("seq"), F.min(titled)["title"].alias("title"), F.count(F.lit(1)).alias("seen"))
