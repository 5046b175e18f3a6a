"""Runs seen as data: dependency gates, progress, status, usage and transcripts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.sources.tables import dealt

ROLES = ("VIEWER", "EDITOR", "ADMIN", "OWNER")


def gate(steps: DataFrame) -> DataFrame:
    """``steps`` (run, step, position, depends_on, status) with ``runnable``: all steps it depends on are COMPLETED."""
    done = steps.where("status = 'COMPLETED'").select("run", F.col("step").alias("dependency"))
    each = steps.select("run", "step", F.explode(F.array_distinct("depends_on")).alias("dependency"))
    open_ = each.join(done, ["run", "dependency"], "left_anti").select("run", "step").distinct().withColumn("_open", F.lit(True))
    return steps.join(open_, ["run", "step"], "left").withColumn("runnable", F.col("_open").isNull()).drop("_open")


def progress(done: Column, total: Column, status: Column) -> Column:
    """Whole percent up to 99; 100 is for completed runs alone."""
    return F.when(status == "COMPLETED", 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(99), F.floor(done * 100 / F.greatest(total, F.lit(1)))))).cast("long")


def run_status(steps: DataFrame) -> DataFrame:
    """run, status from its steps (run, status, records): cancelled, failed (PARTIAL with records), skipped or partial, else completed."""
    any_ = lambda s: F.bool_or(F.col("status") == s)
    status = F.when(any_("CANCELLED"), "CANCELLED").when(any_("FAILED"), F.when(F.sum("records") > 0, "PARTIAL").otherwise("FAILED")).when(any_("SKIPPED") | any_("PARTIAL"), "PARTIAL").otherwise("COMPLETED")
    return steps.groupBy("run").agg(status.alias("status"), F.count(F.lit(1)).alias("steps"), F.count_if(F.col("status") == "COMPLETED").alias("done"))


def status_bucket(c: Column) -> Column:
    """What a list's filter calls a run."""
    return F.when(c.isin("PENDING", "QUEUED", "RUNNING"), "running").when(c.isin("COMPLETED", "PARTIAL"), "completed").when(c.isin("FAILED", "CANCELLED"), "failed").otherwise("other")


def role_allows(role: Column, least: str) -> Column:
    rank = lambda c: F.array_position(F.array(*[F.lit(r) for r in ROLES]), c)
    return F.coalesce(rank(role) >= ROLES.index(least) + 1, F.lit(False)) & (rank(role) > 0)


def relative_label(then: Column, now: Column) -> Column:
    """Minutes, hours or days ago; the date beyond a week."""
    minutes = F.floor((F.unix_millis(now.cast("timestamp")) - F.unix_millis(then.cast("timestamp"))) / 60_000)
    return (
        F.when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago")))
        .when(minutes < 10080, F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(then, "yyyy-MM-dd"))
    )


#: What an action's message says; braces name a detail, or the first there is of several, and what stands for none.
MESSAGES = {
    "RUN_STARTED": "Workflow mission initiated",
    "STAGE_STARTED": "Stage started: {stage|Processing}",
    "STAGE_COMPLETED": "Stage completed: {stage|Processing}",
    "SOURCE_DISCOVERY_STARTED": "Discovering permitted sources...",
    "SOURCE_DISCOVERED": "Discovered source: {url,domain|1 source}",
    "SCRAPE_STARTED": "Collecting source contents...",
    "SCRAPE_COMPLETED": "Collected data from sources",
    "SOURCE_PROCESSED": "Collected data from sources",
    "EXTRACTION_STARTED": "Extracting structured fields...",
    "RECORDS_EXTRACTED": "Extracted {recordCount,count|} records",
    "RECORDS_COLLECTED": "Extracted {recordCount,count|} records",
    "VALIDATION_COMPLETED": "Validation finished: {validRecords|} valid records",
    "DEDUPLICATION_COMPLETED": "Deduplication complete: {duplicatesFound|0} duplicates identified",
    "DEDUP_COMPLETED": "Deduplication complete: {duplicatesFound|0} duplicates identified",
    "DATASET_CREATED": "Cargo dataset materialized",
    "RUN_COMPLETED": "Workflow mission successfully completed",
    "RUN_FAILED": "Mission failed: {error|Internal error}",
}


def activity_message(action: Column, details: Column, message: Column | None = None) -> Column:
    """A sentence for an event: its own message, that of its details (a map of texts), its action's, else the action in plain words."""
    detail = lambda k: F.try_element_at(details, F.lit(k))
    out = F.lower(F.replace(action, F.lit("_"), F.lit(" ")))
    for name, text in MESSAGES.items():
        pieces = []
        for fixed, keys, default in re.findall(r"([^{]*)(?:\{([^|]*)\|([^}]*)\})?", text):
            pieces.append(F.lit(fixed))
            if keys:
                pieces.append(F.coalesce(*[detail(k) for k in keys.split(",")], F.lit(default)))
        out = F.when(action == name, F.concat(*pieces)).otherwise(out)
    own = [message] if message is not None else []
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in own], detail("message"), out)


def latest(events: DataFrame, n: int = 100, order: str = "ts", key: str = "event_id") -> DataFrame:
    """The ``n`` latest events over all runs, the last first."""
    return events.orderBy(F.desc(order), F.desc(key)).limit(n)


#: States of a run that can still fail, and of a step.
OPEN_RUN, OPEN_STEP = ("PENDING", "PLANNING", "RUNNING"), ("PENDING", "RUNNING")


def claim(runs: DataFrame, wanted: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(runs after the claims of ``wanted`` (run, worker), the claims that won: run, worker).

    A run is claimed if it is PENDING and not cancelled, by the least worker that asks: as a merge
    of tables, compare and set is one join. ``runs``: run, status, cancelled_at, started_at, attempt.
    """
    first = wanted.groupBy("run").agg(F.min("worker").alias("worker"))
    out = runs.join(first, "run", "left")
    won = (F.col("status") == "PENDING") & F.col("cancelled_at").isNull() & F.col("worker").isNotNull()
    out = out.withColumn("_won", F.coalesce(won, F.lit(False)))
    claims = out.where("_won").select("run", "worker")
    after = out.withColumns({"status": F.when(F.col("_won"), "RUNNING").otherwise(F.col("status")), "started_at": F.when(F.col("_won"), now).otherwise(F.col("started_at")), "attempt": F.col("attempt") + F.col("_won").cast("int")})
    return after.drop("_won", "worker"), claims


def fail(runs: DataFrame, steps: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, steps, events) after ``failures`` (run, code, message): open runs and their open steps fail, others stay as they are.

    ``runs``: run, status, error_code, error_message; ``steps``: run, step and the same.
    """
    steps, runs, failures = dealt(steps, "run", runs, failures)
    hit = runs.where(F.col("status").isin(*OPEN_RUN)).select("run").join(failures, "run").select("run", F.substring("code", 1, 100).alias("_code"), F.substring("message", 1, 1000).alias("_message"))

    def failed(rows: DataFrame, states: tuple[str, ...]) -> DataFrame:
        rows = rows.join(hit, "run", "left")
        now = F.col("_code").isNotNull() & F.col("status").isin(*states)
        new = {"status": F.lit("FAILED"), "error_code": F.col("_code"), "error_message": F.col("_message")}
        return rows.withColumns({c: F.when(now, v).otherwise(F.col(c)) for c, v in new.items()}).drop("_code", "_message")

    return failed(runs, OPEN_RUN), failed(steps, OPEN_STEP), hit.select("run", F.lit("RUN_FAILED").alias("action"), F.col("_code").alias("error_code"))


def save_once(datasets: DataFrame, new: DataFrame, key: str = "run") -> DataFrame:
    """``datasets`` with the rows of ``new`` whose run has none yet, the first of a run by its other columns; saving again changes nothing."""
    rest = [c for c in datasets.columns if c != key]
    fresh = new.join(datasets.select(key), key, "left_anti").groupBy(key).agg(F.min(F.struct(*rest)).alias("_first"))
    return datasets.unionByName(fresh.select(key, *[F.col(f"_first.{c}").alias(c) for c in rest]))


def usage(events: DataFrame, key: str = "run") -> DataFrame:
    """Sums of tokens, number of tool calls, distinct tools in order, by run: ``events`` (key, tool, tokens_in, tokens_out)."""
    return events.groupBy(key).agg(
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
        F.count("tool").alias("tool_calls"), F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"),
    )


def transcript(messages: DataFrame, cut: int = 2000) -> DataFrame:
    """conv_id, transcript: ``[ROLE i]: text`` blocks in order, an empty line between, each text cut at ``cut``."""
    rows = messages.select("conv_id", "turn", F.concat(F.lit("["), F.upper("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("]: "), F.substring(F.coalesce("text", F.lit("")), 1, cut)).alias("block"))
    blocks = F.transform(F.sort_array(F.collect_list(F.struct("turn", "block"))), lambda x: x["block"])
    return rows.groupBy("conv_id").agg(F.array_join(blocks, "\n\n").alias("transcript"))


def budget_reached(usage_rows: DataFrame, limit: int, share: float = 0.75) -> DataFrame:
    """key, turn of the first row at which the running sum of ``tokens`` comes to a share of the limit."""
    w = W.partitionBy("key").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return usage_rows.withColumn("so_far", F.sum("tokens").over(w)).where(F.col("so_far") >= share * limit).groupBy("key").agg(F.min("turn").alias("turn"))


def strip_empty(m: Column) -> Column:
    """A map of texts without null and empty values."""
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))


def has_result(*columns: Column) -> Column:
    """Whether any text or array holds something."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.length(c.cast("string")) > 0, F.lit(False))
    return out
