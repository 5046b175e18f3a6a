"""Confidence of records and fields, metrics of datasets, and the whole quality pipeline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import urls
from siftwork.functions.text import is_missing
from siftwork.functions.values import clamp, rounded
from siftwork.operators import check, clean, match
from siftwork.operators.store import settled
from siftwork.plans.model import Plan


def confidence(supported: Column, domains: Column, completeness: Column, errors: Column, warnings: Column, conflicts: Column) -> Column:
    """The weights of support, further domains, completeness, freedom of errors, warnings and conflicts."""
    further = F.least(F.lit(0.2), F.greatest(F.lit(0), domains - 1) * 0.1)
    lost = F.least(F.lit(0.2), warnings * 0.025) + F.least(F.lit(0.25), conflicts * 0.1)
    made = F.lit(0.2) + 0.15 + further + completeness * 0.25 + F.when(errors > 0, 0.0).otherwise(0.15) - lost
    return F.when(supported, clamp(made, 0.05, 0.95)).otherwise(0.05)


def state(supported: Column, conflicts: Column) -> Column:
    return F.when(conflicts > 0, "CONFLICTED").when(supported, "SOURCE_CITED_UNVERIFIED").otherwise("UNSUPPORTED")


def domains(source_urls: Column) -> Column:
    """Number of distinct hosts."""
    return F.size(F.array_distinct(F.array_compact(F.transform(source_urls, urls.host))))


def assess(records: DataFrame, plan: Plan) -> DataFrame:
    """``records`` with ``confidence``, ``state`` and ``fields`` (field -> confidence and state)."""
    kinds = plan.by_key()
    missing = lambda k: is_missing(F.col(f"values.`{k}`")) if kinds[k].type == "string" else F.col(f"values.`{k}`").isNull()
    needed = [k for k in plan.needed if k in kinds]
    completeness = sum((F.when(missing(k), 0).otherwise(1) for k in needed), F.lit(0)) / F.lit(float(len(needed))) if needed else F.lit(1.0)
    of = lambda s: F.size(F.filter("issues", lambda x: x["severity"] == s))
    supported = F.size("source_urls") > 0
    out = records.withColumn("confidence", confidence(supported, domains(F.col("source_urls")), completeness, of("ERROR"), of("WARNING"), F.size("conflicts")))
    out = out.withColumn("state", state(supported, F.size("conflicts")))
    each = []
    for f in plan.fields:
        contested = F.array_contains(F.transform("conflicts", lambda x: x["field"]), f.key)
        own = F.when(missing(f.key), 0.0).when(supported, F.least(F.lit(0.7), F.col("confidence"))).otherwise(0.05)
        how = F.when(missing(f.key), "UNSUPPORTED").when(contested, "CONFLICTED").when(supported, "SOURCE_CITED_UNVERIFIED").otherwise("UNSUPPORTED")
        each.append(F.struct(F.lit(f.key).alias("key"), F.struct(own.alias("confidence"), how.alias("state")).alias("value")))
    return out.withColumn("fields", F.map_from_entries(F.array(*each)))


def metrics(assessed: DataFrame, events: DataFrame) -> DataFrame:
    """One row of the thirteen dataset counters. Events are counted by their own job and joined as one row."""
    of = lambda s: F.sum(F.size(F.filter("issues", lambda x: x["severity"] == s)))
    canonical = F.col("duplicate_of").isNull()
    mean = F.coalesce(F.avg(F.when(canonical, F.col("confidence"))), F.lit(0.0))
    counts = assessed.agg(
        F.count(F.lit(1)).alias("raw_records"), F.count(F.lit(1)).alias("normalized_records"), F.count_if(F.size("source_urls") > 0).alias("source_backed"), F.count_if(F.size("source_urls") == 0).alias("unsupported"),
        F.count_if(F.col("is_valid") & canonical).alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"), F.count_if(~canonical).alias("duplicates"),
        F.coalesce(F.sum(F.size("conflicts")), F.lit(0)).cast("long").alias("conflicts"), F.coalesce(of("ERROR"), F.lit(0)).cast("long").alias("errors"), F.coalesce(of("WARNING"), F.lit(0)).cast("long").alias("warnings"),
        rounded(mean).alias("mean_confidence"), rounded(clamp(mean, 0.0, 1.0)).alias("quality_score"),
    )
    return counts.join(events.agg(F.count_if(F.col("decision") == "REVIEW_REQUIRED").alias("review_required")))


@dataclass
class Result:
    records: DataFrame
    events: DataFrame
    metrics: DataFrame


def process(records: DataFrame, plan: Plan, sources: DataFrame | None = None) -> Result:
    """Normalise, validate, deduplicate, resolve and score. What several jobs read is written once: the validated records, and those after deduplication."""
    current = settled(check.validate(clean.normalize(records, plan), plan, sources))
    current, keyed = match.deduplicate(current, plan)
    current = settled(current)
    current, likely = match.resolve(current, plan)
    events = keyed.unionByName(likely)
    assessed = assess(current, plan)
    return Result(assessed, events, metrics(assessed, events))


def dataset_status(inserted: Column, total: Column) -> Column:
    return F.when(inserted == 0, "FAILED").when(inserted < total, "PARTIAL").otherwise("READY")


def result_status(errors: Column, records: Column) -> Column:
    """FAILED without records if there were errors, PARTIAL with both, else COMPLETED."""
    return F.when((errors > 0) & (records == 0), "FAILED").when(errors > 0, "PARTIAL").otherwise("COMPLETED")
