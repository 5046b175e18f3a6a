"""Validation: one array of issues for each record, as a single row-local expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import urls, values
from siftwork.functions.text import is_missing
from siftwork.plans import model
from siftwork.plans.model import Field, Plan

ISSUE = "struct<field:string,rule:string,severity:string,message:string>"
#: Messages of the checks that the schema implies.
MESSAGES = {
    "SOURCE_EVIDENCE": "Record has no URL observed in an enabled collection tool.", "REQUIRED": "Required field is missing.",
    "URL": "Value must be an absolute HTTP(S) URL.", "EMAIL": "Value must be a valid email address.",
    "DATE": "Value must be a valid date in the requested format.", "ENUM": "Value is outside the allowed values for this field.",
    "COUNTRY": "Value was not recognized as a country name or ISO 3166-1 alpha-2 code.",
}


def issue(field: str | None, rule: str, severity: str, message: str) -> Column:
    return F.struct(F.lit(field).cast("string").alias("field"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(message[:1000]).alias("message"))


def is_http_url(c: Column) -> Column:
    return F.coalesce(c.rlike(urls.WEB), F.lit(False))


class Flags:
    """What the checks of a field ask of its value: each flag is a column that is computed once, however many rules test it."""

    def __init__(self):
        self.columns: dict[str, Column] = {}

    def _flag(self, name: str, made: Column) -> Column:
        name = f"_flag_{name}"
        self.columns.setdefault(name, made)
        return F.col(f"`{name}`")

    def missing(self, f: Field) -> Column:
        c = F.col(f"values.`{f.key}`")
        absent = is_missing(c) if f.type == "string" else c.isNull()
        return self._flag(f"missing_{f.key}", absent & F.try_element_at("unparsed", F.lit(f.key)).isNull())

    def fails(self, rule: str, f: Field) -> Column:
        """Whether a value that is there breaks a rule; a value of the wrong type breaks the text rules."""
        value = F.col(f"values.`{f.key}`")
        c = value.cast("string") if f.type in ("string", "number", "integer", "boolean") else F.lit(None).cast("string")
        wrong = F.try_element_at("unparsed", F.lit(f.key)).isNotNull()
        if rule == "TYPE":
            integral = value != F.floor(value) if f.type == "integer" else F.lit(False)
            return self._flag(f"TYPE_{f.key}", wrong | F.coalesce(integral, F.lit(False)))
        test = {
            "URL": lambda: is_http_url(c), "EMAIL": lambda: c.rlike(values.EMAIL), "DATE": lambda: values.is_date(c, f.format == "date-time"),
            "ENUM": lambda: c.isin(*f.enum) if f.enum else F.lit(False), "COUNTRY": lambda: values.is_country(c),
        }[rule]()
        return self._flag(f"{rule}_{f.key}", wrong | ~F.coalesce(test, F.lit(False)))


def _schema_issues(flags: Flags, f: Field, required: bool) -> list[Column]:
    there, wrong = ~flags.missing(f), flags.fails("TYPE", f)
    out = [F.when(~there, issue(f.key, "REQUIRED", "ERROR", MESSAGES["REQUIRED"]))] if required else []
    out.append(F.when(there & wrong, issue(f.key, "TYPE", "ERROR", f"Expected {f.type} value.")))
    rules = [("URL", "ERROR")] * (f.format == "uri") + [("EMAIL", "ERROR")] * (f.format == "email") + [("DATE", "ERROR")] * (f.format in ("date", "date-time"))
    rules += [("ENUM", "ERROR")] * bool(f.enum) + [("COUNTRY", "WARNING")] * model.has_country_token(f.key)
    return out + [F.when(there & ~wrong & flags.fails(rule, f), issue(f.key, rule, severity, MESSAGES[rule])) for rule, severity in rules]


def _explicit(flags: Flags, plan: Plan, supported: Column) -> list[Column]:
    out, fields = [], plan.by_key()
    for r in plan.rules:
        if r.rule == "SOURCE_EVIDENCE":
            out.append(F.when(~supported, issue(r.field, r.rule, r.severity, r.message)))
            continue
        f = fields.get(r.field or "")
        if r.rule == "RANGE" and f is not None and (r.low is not None or r.high is not None):
            c = F.col(f"values.`{f.key}`").try_cast("double")
            outside = F.lit(False)
            outside = outside | (c < r.low) if r.low is not None else outside
            outside = outside | (c > r.high) if r.high is not None else outside
            out.append(F.when(F.coalesce(outside, F.lit(False)), issue(f.key, "RANGE", r.severity, r.message)))
        elif r.rule in ("RANGE", "CUSTOM"):
            out.append(issue(r.field, r.rule, "WARNING", f"Rule requires machine-readable parameters and was not executed: {r.message}"))
        elif f is not None and r.rule == "REQUIRED":
            out.append(F.when(flags.missing(f), issue(f.key, r.rule, r.severity, r.message)))
        elif f is not None:
            out.append(F.when(~flags.missing(f) & flags.fails(r.rule, f), issue(f.key, r.rule, r.severity, r.message)))
    return out


def with_verified_sources(records: DataFrame, sources: DataFrame | None) -> DataFrame:
    """``source_urls`` limited to those that a tool saw (``sources``: url, verified), in their order.

    The sources of a run are joined by their canonical form, exploded and gathered again by
    record; None takes the records' urls as verified.
    """
    if sources is None:
        return records
    seen = sources.where("verified").select(urls.evidence_form(F.col("url")).alias("_form")).where("_form <> ''").distinct()
    each = records.select("rec_idx", F.posexplode("source_urls").alias("_at", "_url")).withColumn("_form", urls.evidence_form(F.col("_url")))
    kept = each.join(seen, "_form", "left_semi").groupBy("rec_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_url"))), lambda x: x["_url"]).alias("_kept"))
    return records.join(kept, "rec_idx", "left").withColumn("source_urls", F.coalesce("_kept", F.array().cast("array<string>"))).drop("_kept")


def validate(records: DataFrame, plan: Plan, sources: DataFrame | None = None) -> DataFrame:
    """``records`` with ``issues`` (no repetitions), ``is_valid`` and a provisional ``confidence``."""
    records = with_verified_sources(records, sources)
    supported, flags = F.size("source_urls") > 0, Flags()
    found = [F.when(~supported, issue(None, "SOURCE_EVIDENCE", "ERROR", MESSAGES["SOURCE_EVIDENCE"]))]
    for f in plan.fields:
        found += _schema_issues(flags, f, f.required or f.key in plan.required)
    found += _explicit(flags, plan, supported)
    issues = F.array_distinct(F.array_compact(F.array(*found))).cast(f"array<{ISSUE}>")
    records = records.withColumns(flags.columns).withColumn("issues", issues).drop(*flags.columns)
    provisional = F.when(supported, F.least(F.lit(0.7), 0.45 + 0.1 * (F.size("source_urls") - 1))).otherwise(0.1)
    return records.withColumns({"is_valid": ~F.exists("issues", lambda x: x["severity"] == "ERROR"), "confidence": provisional})


def summary(validated: DataFrame) -> DataFrame:
    """One row of counts."""
    of = lambda s: F.coalesce(F.sum(F.size(F.filter("issues", lambda x: x["severity"] == s))), F.lit(0)).cast("long")
    return validated.agg(
        F.coalesce(F.sum(F.size("issues")), F.lit(0)).cast("long").alias("issues"), of("ERROR").alias("errors"), of("WARNING").alias("warnings"),
        F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"), F.count_if(F.size("source_urls") == 0).alias("unsupported"),
    )


def issue_table(validated: DataFrame) -> DataFrame:
    """A row for each issue. The outer form keeps the optimizer from deriving a filter that would evaluate all checks twice."""
    return validated.select("rec_idx", F.explode_outer("issues").alias("i")).where("i is not null").select("rec_idx", "i.field", "i.rule", "i.severity", "i.message")
