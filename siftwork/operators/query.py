"""Dataset queries: a typed row query becomes one predicate over one scan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.plans.model import Plan

PAGE_MAX, WORKFLOW_PAGE_MAX = 200, 100
SEVERITIES = ("INFO", "WARNING", "ERROR")
KEY = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def literal(raw: Any) -> Any:
    """A filter's text as boolean or number where it reads as one."""
    if not isinstance(raw, str):
        return raw
    if raw in ("true", "false"):
        return raw == "true"
    if re.fullmatch(r"-?\d+", raw):
        return int(raw)
    return float(raw) if re.fullmatch(r"-?\d*\.\d+", raw) else raw


def contains_any(query: str, *columns: Column) -> Column:
    """Whether the text, in any case, is part of one of the columns. No pattern signs have a meaning."""
    q, out = query.lower(), F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c.cast("string")).contains(q), F.lit(False))
    return out


def known_status(column: Column, status: str | None, known: tuple[str, ...]) -> Column:
    """Whether a row has the status; a status that isn't known filters nothing."""
    return column == status if status in known else F.lit(True)


def compare(column: Column, op: str, value: Any) -> Column:
    """The requirement's filter algebra; a null never matches, but for ``exists`` = False."""
    if op == "exists":
        return column.isNotNull() if value else column.isNull()
    made = {
        "eq": lambda: column == value, "neq": lambda: column != value, "gt": lambda: column > value, "gte": lambda: column >= value,
        "lt": lambda: column < value, "lte": lambda: column <= value, "contains": lambda: F.lower(column.cast("string")).contains(str(value).lower()),
        "in": lambda: column.isin(*value), "between": lambda: column.between(value[0], value[1]), "before": lambda: column < F.lit(value), "after": lambda: column > F.lit(value),
    }[op]()
    return F.coalesce(made, F.lit(False))


def time_range(column: Column, after: str | None = None, before: str | None = None, on: str | None = None) -> Column:
    """Whether a timestamp lies after, before or on a day."""
    at, out = column.cast("timestamp"), F.lit(True)
    if after:
        out = out & (at > F.lit(after).cast("timestamp"))
    if before:
        out = out & (at < F.lit(before).cast("timestamp"))
    if on:
        out = out & (at.cast("date") == F.lit(on).cast("date"))
    return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class RowQuery:
    valid_only: bool = False
    duplicates_only: bool = False
    state: str | None = None
    min_confidence: float | None = None
    max_confidence: float | None = None
    search: str | None = None
    filters: dict[str, Any] = field(default_factory=dict)
    source_id: Any = None
    sort: str = "confidence"
    descending: bool = True
    page: int = 1
    size: int = 50


def checked_filters(filters: dict[str, Any], plan: Plan) -> dict[str, Any]:
    """Filters whose keys are well-formed, in the plan and filterable; anything else is an error."""
    known = plan.by_key()
    for k in filters:
        if not KEY.match(k) or k not in known or not known[k].filterable:
            raise ValueError(f"field {k!r} can't be filtered")
    return filters


def predicate(q: RowQuery, search_columns: list[str], values: str = "values.") -> Column:
    """All conditions of a query in one expression, so that one scan serves them."""
    out = F.lit(True)
    if q.valid_only:
        out = out & F.col("is_valid")
    if q.duplicates_only:
        out = out & F.col("duplicate_of").isNotNull()
    if q.state:
        out = out & (F.col("state") == q.state)
    if q.min_confidence is not None:
        out = out & (F.col("confidence") >= q.min_confidence)
    if q.max_confidence is not None:
        out = out & (F.col("confidence") <= q.max_confidence)
    if q.search:
        out = out & contains_any(q.search, *[F.col(c) for c in search_columns])
    for k, v in q.filters.items():
        out = out & F.coalesce(F.col(f"{values}`{k}`") == F.lit(literal(v)), F.lit(False))
    return out


def page(df: DataFrame, number: int, size: int, *order: Column | str, most: int = PAGE_MAX) -> DataFrame:
    """A page of ``df``; ``order`` ends with a unique column, so pages neither overlap nor leave gaps."""
    size = min(most, max(1, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def envelope(df: DataFrame, size: int, most: int = PAGE_MAX) -> DataFrame:
    """One row: total and total_pages (1 at least)."""
    size = min(most, max(1, size))
    return df.agg(F.count(F.lit(1)).alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long").alias("total_pages"))


def rows(dataset: DataFrame, q: RowQuery, search_columns: list[str], evidence: DataFrame | None = None, key: str = "rec_idx", values: str = "values.") -> DataFrame:
    """The page of a dataset's rows that a query asks for. A source filter is a semi-join with ``evidence``."""
    found = dataset.where(predicate(q, search_columns, values))
    if q.source_id is not None and evidence is not None:
        found = found.join(evidence.where(F.col("source_id") == q.source_id), key, "left_semi")
    by = F.desc(q.sort) if q.descending else F.asc(q.sort)
    return page(found, q.page, q.size, by, key)


def tenant(df: DataFrame, members: DataFrame, user: Any) -> DataFrame:
    """Rows of the workspaces in which a user is an active member."""
    mine = members.where((F.col("user_id") == user) & (F.col("status") == "ACTIVE")).select("workspace_id")
    return df.join(mine, "workspace_id", "left_semi")


def require_member(members: DataFrame, user: Any, workspace: Any) -> None:
    """Raises if the user isn't an active member."""
    if members.where((F.col("user_id") == user) & (F.col("workspace_id") == workspace) & (F.col("status") == "ACTIVE")).isEmpty():
        raise PermissionError("not an active member of the workspace")


def confidence_bucket(c: Column) -> Column:
    """Half-open: high from .85, medium from .70, else low."""
    return F.when(c >= 0.85, "high").when(c >= 0.70, "medium").when(c.isNotNull(), "low")


def severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), c)


def latest(df: DataFrame, parent: str, order: str, n: int = 1, tie: str | None = None) -> DataFrame:
    """The last ``n`` rows of each parent; for one row it is an aggregate that is combined before the shuffle."""
    if n == 1:
        keys = F.struct(F.col(order), *([F.col(tie)] if tie else []))
        m = df.groupBy(parent).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns if c != parent]), keys).alias("m"))
        return m.select(*[F.col(parent) if c == parent else F.col(f"m.`{c}`").alias(c) for c in df.columns])
    from pyspark.sql import Window as W

    w = W.partitionBy(parent).orderBy(F.desc(order), *([F.desc(tie)] if tie else []))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def with_count(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """``parents`` with the number of their children, 0 included; children are counted before they are joined."""
    counts = children.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def percent(c: Column) -> Column:
    """A confidence of up to 1 as whole percent, larger ones as they are, rounded half up; 90 for null."""
    return F.when(c.isNull(), 90).otherwise(F.floor(F.when(c <= 1, c * 100).otherwise(c) + 0.5)).cast("long")


def duration_ms(started: Column, finished: Column, now: Column) -> Column:
    """Milliseconds of a run, 0 at least; an open run lasts until ``now``."""
    return F.greatest(F.lit(0), F.unix_millis(F.coalesce(finished, now).cast("timestamp")) - F.unix_millis(started.cast("timestamp")))


def export_columns(requested: list[str], plan: Plan) -> list[str]:
    """Requested keys that the schema has, in its order; all if none is left."""
    own = [f.key for f in plan.fields]
    return [k for k in own if k in requested] or own
