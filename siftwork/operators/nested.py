"""Nested documents: trees taken apart and put together, source lists ranked wherever they stand, conformance of all items, inner values in standard forms.

JSON texts are parsed to VARIANT, whose objects have sorted keys; texts that aren't JSON pass
unchanged, or conform to nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import text, urls, values
from siftwork.operators import rank
from siftwork.operators.govern import decide
from siftwork.operators.store import settled
from siftwork.plans.model import Plan, SourcePolicy

LIST, MAP = "array<variant>", "map<string,variant>"
STEP = "struct<at:int,key:string>"
#: Containers below which conformance isn't looked at.
DEEPEST = 6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def items(v: Column) -> Column:
    """Items of an array; null for anything else."""
    return F.try_variant_get(v, "$", LIST)


def entries(v: Column) -> Column:
    """Map of an object's entries; null for anything else."""
    return F.try_variant_get(v, "$", MAP)


def string_at(v: Column, path: str) -> Column:
    """The text at a path, null if there is none or another kind of value."""
    inner = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(v, path, "string"))


def _quoted(c: Column) -> Column:
    """A text as a JSON string."""
    return let(F.to_json(F.array(c)), lambda q: F.substring(q, F.lit(2), F.length(q) - 2))


def depth(json: Column) -> Column:
    """How many containers of a JSON text lie within one another: brackets outside of strings."""
    outside = F.regexp_replace(F.regexp_replace(json, r"\\.", ""), '"[^"]*"', "")
    brackets = F.split(F.regexp_replace(outside, r"[^\[\]{}]", ""), "")
    one = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, x: Column) -> Column:
        now = a["now"] + F.when(x.isin("[", "{"), 1).when(x.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(brackets, one, step, lambda a: a["most"])


def explode(docs: DataFrame, levels: int, stop: Callable[[Column], Column] | None = None) -> DataFrame:
    """The leaves of ``docs`` (row, doc: variant): row, path (ordinal, and key in an object, of each step), leaf, stopped.

    Each level replaces a container by its children, in the same task. Array items for which
    ``stop`` holds are kept whole. Scalars and empty containers are leaves.
    """
    out = docs.select("row", F.array().cast(f"array<{STEP}>").alias("path"), F.col("doc").alias("leaf"), F.lit(False).alias("stopped"))
    for _ in range(levels):
        v = F.col("leaf")
        step = lambda at, key: F.concat("path", F.array(F.struct(at.cast("int").alias("at"), key.cast("string").alias("key"))))
        item = lambda x, i: F.struct(step(i, F.lit(None)).alias("path"), x.alias("leaf"), (stop(x) if stop else F.lit(False)).alias("stopped"))
        entry = lambda e, i: F.struct(step(i, e["key"]).alias("path"), e["value"].alias("leaf"), F.lit(False).alias("stopped"))
        children = F.coalesce(F.transform(items(v), item), F.transform(F.map_entries(entries(v)), entry))
        itself = F.array(F.struct("path", "leaf", "stopped"))
        out = out.select("row", F.explode(F.when(~F.col("stopped") & (F.size(children) > 0), children).otherwise(itself)).alias("n")).select("row", "n.*")
    return out


def assemble(nodes: DataFrame, levels: int) -> DataFrame:
    """row and json of ``nodes`` (row, path, json), from the deepest level up. A null json leaves its place out of its array or object, which stays.

    All levels group within one partitioning by row.
    """
    out = nodes.select("row", "path", "json").repartition("row")
    for level in range(levels, 0, -1):
        child = F.size("path") >= level
        step = F.element_at("path", -1)
        each = F.struct(F.when(child, step["at"]).alias("at"), F.when(child, step["key"]).alias("key"), "json")
        grouped = out.groupBy("row", F.slice("path", 1, level - 1).alias("path")).agg(F.max(child).alias("inner"), F.bool_or(child & step["key"].isNotNull()).alias("named"), F.sort_array(F.collect_list(each)).alias("parts"))
        kept = F.filter("parts", lambda p: p["json"].isNotNull())
        array = F.concat(F.lit("["), F.array_join(F.transform(kept, lambda p: p["json"]), ","), F.lit("]"))
        object_ = F.concat(F.lit("{"), F.array_join(F.transform(kept, lambda p: F.concat(_quoted(p["key"]), F.lit(":"), p["json"])), ","), F.lit("}"))
        out = grouped.select("row", "path", F.when(~F.col("inner"), F.col("parts")[0]["json"]).when(F.col("named"), object_).otherwise(array).alias("json"))
    return out.select("row", "json")


#: What ``urls.ranking_form`` takes: an http(s) URL without credentials.
_WEB = urls.GRAMMAR.replace("([A-Za-z][A-Za-z0-9+.-]*)", "[Hh][Tt][Tt][Pp][Ss]?", 1).replace("([^/?#@]*)@", "@", 1)


def candidate_url(v: Column) -> Column:
    """The address of a search hit: an object's ``url``, else its ``link``, if pages can be found there."""
    found = F.coalesce(string_at(v, "$.url"), string_at(v, "$.link"))
    return F.when(entries(v).isNotNull() & found.rlike(_WEB), found)


def filter_and_rank(results: DataFrame, queries: list[str], limit: int, policy: SourcePolicy | None = None, payload: str = "payload") -> DataFrame:
    """``results`` with each list of search hits in ``payload``, wherever it stands, cut down to the chosen ones in their old order.

    In a list that holds hits, those that the policy forbids go, the rest are ranked against each
    other and the best ``limit`` stay as they are; its other items, and all other values, are
    searched further. Lists rank apart from each other. Null payloads and texts that aren't JSON stay; repeated rows
    are each rewritten; keys come out sorted.
    """
    kept = settled(results.select(F.expr("uuid()").alias("row"), F.struct(*[F.col(f"`{c}`") for c in results.columns]).alias("old")))
    source = F.col(f"old.`{payload}`")
    docs = kept.select("row", F.try_parse_json(source).alias("doc"), depth(source).alias("depth")).where("doc is not null")
    levels = docs.agg(F.max("depth")).first()[0] or 0
    nodes = settled(explode(docs, levels, lambda x: F.coalesce(candidate_url(x).isNotNull(), F.lit(False))).select("row", "path", F.to_json("leaf").alias("json"), "stopped"))
    hit = F.parse_json("json")
    hits = nodes.where("stopped").select(
        "row", F.slice("path", 1, F.size("path") - 1).alias("list"), F.element_at("path", -1)["at"].alias("idx"), candidate_url(hit).alias("url"),
        F.coalesce(string_at(hit, "$.title"), F.lit("")).alias("title"), F.coalesce(string_at(hit, "$.description"), string_at(hit, "$.snippet"), F.lit("")).alias("snippet"),
    )
    if policy is not None:
        hits = decide(hits, policy).where("allowed").select(*hits.columns)
    chosen = rank.rank(hits, queries, limit, policy.preferred if policy else (), by=("row", "list")).select("row", F.concat("list", F.array(F.struct(F.col("idx").cast("int").alias("at"), F.lit(None).cast("string").alias("key")))).alias("path"), F.lit(True).alias("chosen"))
    judged = nodes.join(chosen, ["row", "path"], "left").select("row", "path", F.when(~F.col("stopped") | F.col("chosen"), F.col("json")).alias("json"))
    made = assemble(judged, levels).withColumnRenamed("json", "_made")
    out = kept.join(made, "row", "left")
    return out.select(*[F.coalesce("_made", source).alias(c) if c == payload else F.col(f"old.`{c}`").alias(c) for c in results.columns])


def _is_empty(v: Column) -> Column:
    """Absent, null, a blank text or an empty array."""
    blank = (F.schema_of_variant(v) == "STRING") & F.try_variant_get(v, "$", "string").rlike(rf"^{text.SPACE}*\z")
    return F.coalesce(v.isNull() | F.is_variant_null(v) | blank | (F.size(items(v)) == 0), F.lit(False))


def _named(prefix: Column | None, key: str) -> Column:
    return F.lit(key) if prefix is None else F.concat(prefix, F.lit(f".{key}"))


def _misses(schema, v: Column, prefix: Column | None, level: int = 0) -> Column:
    """What of ``schema`` (nested lists and dicts, null at the leaves) ``v`` lacks: one expression for each place of the schema, run over all items."""
    none, root = F.array().cast("array<string>"), F.lit("(root)") if prefix is None else prefix
    if level > DEEPEST:
        return none
    if isinstance(schema, list):
        at = F.lit("") if prefix is None else prefix

        def listed(found: Column) -> Column:
            if not schema:
                rest = none
            elif isinstance(schema[0], (list, dict)):
                rest = F.flatten(F.transform(found, lambda x, i: _misses(schema[0], x, F.concat(at, F.lit("["), i.cast("string"), F.lit("]")), level + 1)))
            else:
                rest = F.when(F.exists(found, _is_empty), F.array(F.concat(at, F.lit("[] (one or more items empty)")))).otherwise(none)
            return F.when(found.isNull() | (F.size(found) == 0), F.array(F.concat(at, F.lit("[]")))).otherwise(rest)

        return let(items(v), listed)
    if isinstance(schema, dict):
        return let(entries(v), lambda found: _lacking(schema, found, prefix, level))
    return F.when(_is_empty(v), F.array(root)).otherwise(none)


def _lacking(schema: dict, found: Column, prefix: Column | None, level: int) -> Column:
    """What of an object's ``schema`` the map of its entries lacks."""
    none, root, parts = F.array().cast("array<string>"), F.lit("(root)") if prefix is None else prefix, []
    for key, inner in schema.items():
        path, own = _named(prefix, key), F.try_element_at(found, F.lit(key))
        rest = _misses(inner, own, path, level + 1) if isinstance(inner, (list, dict)) else let(own, partial(lambda path, x: F.when(_is_empty(x), F.array(path)).otherwise(none), path))
        parts.append(F.when(F.map_contains_key(found, key), rest).otherwise(F.array(path)))
    return F.when(found.isNull(), F.array(root)).otherwise(F.concat(none, *parts))


def conformance(json: Column, schema) -> Column:
    """Struct of ``missing`` (paths that name the item, as in ``a[3].b``) and ``extra`` (top-level keys that the schema doesn't know) of a JSON text. A text that isn't JSON is a null document."""
    none = F.array().cast("array<string>")

    def told(missing: Column, extra: Column) -> Column:
        return F.struct(missing.alias("missing"), extra.alias("extra"))

    def of_entries(found: Column) -> Column:
        """An object's entries are taken apart once for both."""
        return told(_lacking(schema, found, None, 0), F.coalesce(F.array_except(F.map_keys(found), F.array(*[F.lit(k) for k in schema]).cast("array<string>")), none))

    if isinstance(schema, dict):
        return let(entries(F.try_parse_json(json)), of_entries)
    return let(F.try_parse_json(json), lambda v: told(_misses(schema, v, None), none))


def canonical(json: Column) -> Column:
    """A JSON text with the keys of all its objects sorted and no white space."""
    return F.to_json(F.parse_json(json))


#: Pieces of a compact JSON text: strings, other scalars, brackets. Possessive, so that long texts need no stack.
TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]{}]|[^\s\[\]{}:,"]++'


def _inner(c: Column, key: Column, plan: Plan) -> Column:
    """JSON of a text in the standard form that its key asks for; null for words that mean "no value"."""
    name = F.regexp_replace(text.fold(key), "[^a-z0-9]", "")
    asked = lambda operation: key.isin(*[k for k, o in plan.transforms if o == operation]) if any(o == operation for _, o in plan.transforms) else F.lit(False)
    rules = [
        (name.contains("email"), F.lower), (name.rlike("country$"), values.country), (asked("NORMALIZE_URL"), lambda x: F.coalesce(urls.dataset_form(x), x)), (asked("NORMALIZE_DATE"), lambda x: F.coalesce(values.iso_date(x), x)),
        (name.rlike("phone|mobile|telephone") | asked("NORMALIZE_PHONE"), lambda x: F.coalesce(values.phone(x), x)),
        (name.rlike("funding|salary|price|revenue|amount|cost|budget|valuation") | asked("NORMALIZE_CURRENCY"), lambda x: F.when(values.number(x).isNotNull(), values.currency(x)).otherwise(x)),
    ]
    made = text.clean(c)
    for rule in rules:
        made = let(made, partial(lambda rule, x: F.when(rule[0], rule[1](x)).otherwise(x), rule))
    number = lambda x: F.when(asked("PARSE_NUMBER"), values.plain_number(values.number(x)))
    return let(made, lambda x: F.when(x.isNotNull(), F.coalesce(number(x), _quoted(x))))


def normal_json(json: Column, key: str, plan: Plan) -> Column:
    """A JSON text whose inner texts are in the standard forms of their own keys, on every level.

    Items of arrays have their array's key, and those without a value go, as an array does that
    has none left; an object's entry without a value is null. Keys come out sorted. One fold
    over the text's pieces, with the open containers as a stack: a row's work grows with its text
    and its containers' sizes, and nothing is shuffled.
    """
    frame = lambda named, pending, array, body: F.struct(named.alias("name"), pending.alias("pending"), array.alias("array"), body.alias("body"))
    null = F.lit(None).cast("string")
    unquoted = lambda t: F.get(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), F.lit(0))

    def add(stack: Column, value: Column) -> Column:
        """``stack`` with a finished value in its last container."""

        def put(top: Column) -> Column:
            entry = F.when(top["array"], value).otherwise(F.concat(top["pending"], F.lit(":"), F.coalesce(value, F.lit("null"))))
            body = let(entry, lambda e: F.when(e.isNull(), top["body"]).when(top["body"] == "", e).otherwise(F.concat(top["body"], F.lit(","), e)))
            return F.concat(F.slice(stack, F.lit(1), F.size(stack) - 1), F.array(frame(top["name"], null, top["array"], body)))

        return let(F.element_at(stack, -1), put)

    def step(stack: Column, t: Column) -> Column:
        def with_top(top: Column) -> Column:
            name = F.when(top["array"], top["name"]).otherwise(unquoted(top["pending"]))
            opened = F.concat(stack, F.array(frame(name, null, t == "[", F.lit(""))))
            closed = F.when(t == "}", F.concat(F.lit("{"), top["body"], F.lit("}"))).when(top["body"] != "", F.concat(F.lit("["), top["body"], F.lit("]")))
            named = F.concat(F.slice(stack, F.lit(1), F.size(stack) - 1), F.array(frame(top["name"], t, top["array"], top["body"])))
            scalar = F.when(t.startswith('"'), let(name, lambda n: _inner(unquoted(t), n, plan))).when(t != "null", t)
            return (
                F.when(t.isin("{", "["), opened)
                .when(t.isin("}", "]"), add(F.slice(stack, F.lit(1), F.size(stack) - 1), closed))
                .when(~top["array"] & top["pending"].isNull(), named)
                .otherwise(add(stack, scalar))
            )

        return let(F.element_at(stack, -1), with_top)

    root = F.array(frame(F.lit(key), null, F.lit(True), F.lit("")))
    return F.nullif(F.aggregate(F.regexp_extract_all(canonical(json), F.lit(TOKEN), F.lit(0)), root, step, lambda s: s[0]["body"]), F.lit(""))
