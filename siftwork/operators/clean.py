"""Normalisation: any input columns to the plan's fields, in standard forms, with the raw values kept.

Input: ``rec_idx``, ``source_urls`` and one column for each input name. Output: ``rec_idx``,
``source_urls``, ``raw_values`` (struct of the input columns), ``values`` (struct of the plan's
fields), ``unparsed`` (texts of fields that should be numbers or booleans but aren't) and
``notes`` (field -> remarks). Row-local expressions only: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import text, urls, values
from siftwork.functions.text import fold_key
from siftwork.operators import nested
from siftwork.plans import model
from siftwork.plans.model import Field, Plan

RESERVED = ("rec_idx", "source_urls")


def text_value(c: Column, f: Field, plan: Plan) -> Column:
    """A text in the field's standard form; forms are applied one after the other, each only where it understands the value."""
    c = text.clean(c)
    if model.is_email_field(f):
        c = F.lower(c)
    if model.is_country_field(f):
        c = values.country(c)
    if model.is_url_field(f) or plan.transformed(f.key, "NORMALIZE_URL"):
        c = F.coalesce(urls.dataset_form(c), c)
    if model.is_date_field(f) or plan.transformed(f.key, "NORMALIZE_DATE"):
        c = F.coalesce(values.iso_date(c), c)
    if model.is_phone_field(f) or plan.transformed(f.key, "NORMALIZE_PHONE"):
        c = F.coalesce(values.phone(c), c)
    if f.type in ("string", "array") and (model.is_money_field(f) or plan.transformed(f.key, "NORMALIZE_CURRENCY")):
        c = F.when(values.number(c).isNotNull(), values.currency(c)).otherwise(c)
    if f.type in ("string", "array") and plan.transformed(f.key, "PARSE_NUMBER"):
        c = F.coalesce(values.plain_number(values.number(c)), c)
    return c


def prepared(c: Column, kind: str, f: Field, plan: Plan) -> Column:
    """The input in standard forms, before its type is looked at."""
    if kind.startswith("array"):
        items = F.filter(F.transform(c, lambda x: text_value(x.cast("string"), Field(f.key, "array"), plan)), lambda x: x.isNotNull())
        return F.when(F.size(items) > 0, items)
    if kind.startswith(("map", "struct")):
        # inner values by their own keys, on every level; what is nested stays JSON
        return F.from_json(nested.normal_json(F.to_json(c, {"ignoreNullFields": "false"}), f.key, plan), "map<string,string>")
    return text_value(c.cast("string"), f, plan)


def typed_value(made: Column, c: Column, kind: str, f: Field) -> tuple[Column, Column]:
    """(value in the field's type, text that isn't of that type) of a prepared input."""
    nothing, none = F.lit(None).cast("string"), F.lit(None).cast(f.spark_type)
    if kind.startswith("array"):
        return (made, nothing) if f.type == "array" else (none, F.to_json(made))
    if kind.startswith(("map", "struct")):
        return (made, nothing) if f.type == "object" else (none, F.to_json(made))
    if f.type in ("number", "integer"):
        value = values.number(made) if kind == "string" else c.cast("double")
        return value, F.when(value.isNull(), made)
    if f.type == "boolean":
        value = c if kind == "boolean" else F.lit(None).cast("boolean")
        return value, F.when(value.isNull(), made)
    return (made, nothing) if f.type == "string" else (none, made)


def _note(c: Column, kind: str, f: Field) -> Column:
    """Remark that a currency code was left out of a number."""
    if f.type in ("number", "integer") and kind == "string" and model.is_money_field(f):
        code = values.currency_code(text.clean(c))
        return F.when(code.isNotNull() & values.number(text.clean(c)).isNotNull(), F.concat(F.lit("Currency code "), code, F.lit(" is kept in the raw value; the number is the amount.")))
    return F.lit(None).cast("string")


def normalize(records: DataFrame, plan: Plan) -> DataFrame:
    """In three projections, each of which uses what the one before made: inputs in standard forms, typed values, the record.

    What a projection makes at some cost and the next uses more than once is a column, which
    the optimizer doesn't copy into its uses.
    """
    names, kinds = plan.names(), dict(records.dtypes)
    inputs = [c for c in records.columns if c not in RESERVED]
    sources: dict[str, list[str]] = {}
    for c in inputs:
        sources.setdefault(names.get(fold_key(c), c), []).append(c)
    forms, typed, found = {}, {}, {}
    for f in plan.fields:
        for c in sources.get(f.key, []):
            n = len(forms)
            forms[f"_form{n}"] = prepared(F.col(f"`{c}`"), kinds[c], f, plan)
            typed[f"_value{n}"], typed[f"_text{n}"] = typed_value(F.col(f"_form{n}"), F.col(f"`{c}`"), kinds[c], f)
            found.setdefault(f.key, []).append((F.col(f"_value{n}"), F.col(f"_text{n}"), c))
    made, rest, notes = [], [], []
    for f in plan.fields:
        own = found.get(f.key, [])
        if not own:
            made.append(F.lit(None).cast(f.spark_type).alias(f.key))
            continue
        kept = F.coalesce(*[v for v, _, _ in own])
        made.append(kept.alias(f.key))
        rest.append(F.struct(F.lit(f.key).alias("key"), F.when(kept.isNull(), F.coalesce(*[u for _, u, _ in own])).alias("value")))
        remarks = [_note(F.col(f"`{c}`"), kinds[c], f) for _, _, c in own]
        if len(own) > 1 and f.type not in ("object",):
            differs = F.lit(False)
            for v, _, _ in own:
                differs = differs | (v.isNotNull() & ~v.eqNullSafe(kept))
            remarks.append(F.when(differs, F.concat(F.lit("Several inputs differ for "), F.lit(f.key), F.lit("; the first value that isn't empty was kept."))))
        notes.append(F.struct(F.lit(f.key).alias("key"), F.array_compact(F.array(*remarks)).alias("value")))
    # names that the plan doesn't know pass through as texts
    for key, cols in sources.items():
        if key not in plan.by_key():
            rest.append(F.struct(F.lit(key).alias("key"), text.clean(F.coalesce(*[_as_text(c, kinds[c]) for c in cols])).alias("value")))
    unparsed = F.map_from_entries(F.filter(F.array(*rest), lambda x: x["value"].isNotNull())) if rest else F.create_map().cast("map<string,string>")
    remarks = F.map_from_entries(F.filter(F.array(*notes), lambda x: F.size(x["value"]) > 0)) if notes else F.create_map().cast("map<string,array<string>>")
    records = records.withColumns(forms) if forms else records
    records = records.withColumns(typed) if typed else records
    return records.select(
        "rec_idx", "source_urls", F.struct(*[F.col(f"`{c}`") for c in inputs]).alias("raw_values"), F.struct(*made).alias("values"), unparsed.alias("unparsed"), remarks.alias("notes"),
    )


def _as_text(c: str, kind: str) -> Column:
    return F.to_json(F.col(f"`{c}`")) if kind.startswith(("array", "map", "struct")) else F.col(f"`{c}`").cast("string")
