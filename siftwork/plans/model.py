"""Plans: what a dataset's records look like, and how they are cleaned, checked and matched.

A plan is compiled on the driver into column expressions; nothing in it depends on data.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

from siftwork.functions.text import fold_key

#: Other names of well-known fields.
ALIASES = {
    "company_name": ("company", "organization", "organisation", "business", "companyname", "organizationname", "organisationname"),
    "person_name": ("person", "contact", "contactname", "fullname", "foundername"),
    "website": ("url", "web", "homepage", "companyurl", "websiteurl"),
    "email": ("e-mail", "emailaddress", "contactemail"),
    "phone": ("telephone", "phonenumber", "contactnumber", "mobile"),
    "linkedin_url": ("linkedin", "linkedinprofile", "linkedinprofileurl"),
    "country": ("nation", "countryname", "countrycode"),
    "founded_date": ("foundingdate", "datefounded", "founded", "establisheddate"),
}
SPARK_TYPES = {"string": "string", "number": "double", "integer": "double", "boolean": "boolean", "array": "array<string>", "object": "map<string,string>"}
STORED_FORMATS = {"date": "DATE", "date-time": "DATETIME", "uri": "URL", "email": "EMAIL"}
STORED_TYPES = {"number": "NUMBER", "integer": "NUMBER", "boolean": "BOOLEAN", "array": "JSON", "object": "JSON"}
MAX_LABEL = 64
#: What is asked for if a requirement has no objective, no entity type, no fields.
MISSING = ("A clear objective for the requested dataset", "The kind of entity or information to collect", "At least one requested field or attribute")


@dataclass(frozen=True)
class Field:
    key: str
    type: str = "string"
    format: str | None = None
    enum: tuple[str, ...] = ()
    required: bool = False
    label: str = ""
    filterable: bool = True

    @property
    def spark_type(self) -> str:
        return SPARK_TYPES[self.type]

    @property
    def stored_type(self) -> str:
        """Column type of the catalog: the format counts before the type."""
        return STORED_FORMATS.get(self.format or "", STORED_TYPES.get(self.type, "STRING"))


@dataclass(frozen=True)
class Rule:
    """An explicit check; ``low`` and ``high`` are the bounds of a RANGE rule."""

    rule: str
    field: str | None = None
    severity: str = "ERROR"
    message: str = ""
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class MatchRule:
    keys: tuple[str, ...]
    strategy: str = "NORMALIZED"
    threshold: float = 0.94
    ambiguous: str = "REVIEW_REQUIRED"


@dataclass(frozen=True)
class Step:
    id: str
    kind: str
    depends_on: tuple[str, ...] = ()


@dataclass(frozen=True)
class SourcePolicy:
    allowed: tuple[str, ...] = ()
    blocked: tuple[str, ...] = ()
    preferred: tuple[str, ...] = ()
    per_minute: int = 30


@dataclass(frozen=True)
class Plan:
    fields: tuple[Field, ...]
    rules: tuple[Rule, ...] = ()
    match_rules: tuple[MatchRule, ...] = ()
    transforms: tuple[tuple[str, str], ...] = ()
    required: tuple[str, ...] = ()
    steps: tuple[Step, ...] = ()
    policy: SourcePolicy = field(default_factory=SourcePolicy)

    def by_key(self) -> dict[str, Field]:
        return {f.key: f for f in self.fields}

    @property
    def needed(self) -> list[str]:
        """Fields that count for completeness: the requirement's, else the schema's."""
        return list(self.required) or [f.key for f in self.fields if f.required]

    def transformed(self, key: str, operation: str) -> bool:
        return (key, operation) in self.transforms

    def names(self) -> dict[str, str]:
        """Folded input name -> field; labels win over aliases, aliases over keys."""
        out = {fold_key(f.key): f.key for f in self.fields}
        for well_known, others in ALIASES.items():
            target = next((f.key for f in self.fields if fold_key(f.key) == fold_key(well_known)), None)
            if target:
                out |= {fold_key(o): target for o in others}
        for f in self.fields:
            label = fold_key(f.label)
            if label and len(label) <= MAX_LABEL:
                out[label] = f.key
        return out

    def digest(self) -> str:
        """SHA-256 of the plan in a stable form."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()

    def problems(self) -> list[str]:
        """What is inconsistent: step ids, dependencies, missing stages, unknown keys."""
        keys, seen, out = set(self.by_key()), set(), []
        if len(keys) < len(self.fields):
            out.append("field keys repeat")
        for s in self.steps:
            if s.id in seen:
                out.append(f"step {s.id} repeats")
            out += [f"step {s.id} depends on {d}, which isn't before it" for d in s.depends_on if d not in seen]
            seen.add(s.id)
        if self.steps:
            out += [f"no {k} step" for k in ("EXTRACT", "SAVE") if k not in {s.kind for s in self.steps}]
        out += [f"rule on unknown field {r.field}" for r in self.rules if r.field and r.field not in keys]
        out += [f"match rule on unknown field {k}" for m in self.match_rules for k in m.keys if k not in keys]
        out += [f"transform of unknown field {k}" for k, _ in self.transforms if k not in keys]
        out += [f"required field {k} is unknown" for k in self.required if k not in keys]
        return out


@dataclass(frozen=True)
class Requirement:
    fields: tuple[str, ...]
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    missing: tuple[str, ...] = ()

    def problems(self) -> list[str]:
        """Required and optional fields must part the fields between them."""
        both = set(self.required) & set(self.optional)
        loose = set(self.fields) - set(self.required) - set(self.optional)
        foreign = (set(self.required) | set(self.optional)) - set(self.fields)
        return [f"{x} is required and optional" for x in sorted(both)] + [f"{x} is neither required nor optional" for x in sorted(loose)] + [f"{x} isn't a field" for x in sorted(foreign)]

    def missing_information(self, objective: str, entity: str) -> list[str]:
        """What a user should still be asked: given points, then what the requirement lacks, without repetition."""
        lacks = (not objective, not entity, not self.fields)
        return list(dict.fromkeys([*self.missing, *[text for text, lack in zip(MISSING, lacks) if lack]]))


#: What detectors look for in folded keys (the first group) and in keys as they are.
URL_END, URL_NAMES = "url", ("website", "domain")
DATE_END, DATE_NAMES = "date", ("founded",)
PHONE_WORDS = ("phone", "mobile", "telephone")
MONEY = re.compile("funding|salary|price|revenue|amount|cost|budget|valuation")
COUNTRY_TOKEN = re.compile(r"(?i)(^|_)(country|nation)(_|$)")
URL_TOKEN = re.compile(r"(?i)(^|_)(url|website|domain|linkedin)(_|$)")
IDENTIFIER = re.compile(r"(?i)(website|url|domain|linkedin|email|registration|tax)")
NAME = re.compile(r"(?i)(^|_)(company|organization|organisation|entity|person|event|product)?_?name$|^name$")


# field detectors: by folded key and declared type
def is_url_field(f: Field) -> bool:
    k = fold_key(f.key)
    return f.type == "string" and (k.endswith(URL_END) or k in URL_NAMES)


def is_date_field(f: Field) -> bool:
    k = fold_key(f.key)
    return f.type == "string" and (k.endswith(DATE_END) or k in DATE_NAMES)


def is_phone_field(f: Field) -> bool:
    return any(w in fold_key(f.key) for w in PHONE_WORDS)


def is_money_field(f: Field) -> bool:
    return bool(MONEY.search(fold_key(f.key)))


def is_email_field(f: Field) -> bool:
    return "email" in fold_key(f.key)


def is_country_field(f: Field) -> bool:
    return fold_key(f.key).endswith("country")


def has_country_token(key: str) -> bool:
    return bool(COUNTRY_TOKEN.search(key))


def is_url_key(key: str) -> bool:
    return bool(URL_TOKEN.search(key))


def is_identifier(key: str) -> bool:
    return bool(IDENTIFIER.search(key))


def name_field(plan: Plan) -> str | None:
    """First field that names an entity."""
    return next((f.key for f in plan.fields if NAME.search(f.key)), None)


def leaf_paths(schema: T.DataType, depth: int = 4, prefix: str = "") -> list[str]:
    """Dotted paths of a schema's leaves, down to ``depth``; array items are walked through."""
    while isinstance(schema, T.ArrayType):
        schema = schema.elementType
    if not isinstance(schema, T.StructType) or depth == 0:
        return [prefix] if prefix else []
    return [p for f in schema.fields for p in leaf_paths(f.dataType, depth - 1, f"{prefix}.{f.name}" if prefix else f.name)]


def conformance(wanted: T.StructType, found: T.StructType, depth: int = 6) -> tuple[list[str], list[str]]:
    """(paths of ``wanted`` that ``found`` lacks, top-level names that only ``found`` has)."""
    lacking = sorted(set(leaf_paths(wanted, depth)) - set(leaf_paths(found, depth)))
    return lacking, sorted(set(found.names) - set(wanted.names))
