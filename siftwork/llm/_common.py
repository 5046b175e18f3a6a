"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.operators.store import clear_workspaces, materialize, workspace

__all__ = ["BROADCAST_ROWS", "UNROLLED", "WORD", "clear_workspaces", "let", "materialize", "open_fs", "read_table", "row_key", "uniform", "unroll", "words", "workspace"]

#: Fixed value: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table that is broadcast at most; above, the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Copies of a row that one task makes.
UNROLLED = 10_000


def row_key(*columns: str) -> Column:
    """16 bytes for the contents of a row in ``columns``: equal rows have equal keys, wherever they lie."""
    return F.substring(F.unhex(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])), 256)), 1, 16)


def unroll(rows: DataFrame, times: str, nth: str) -> DataFrame:
    """Each row as often as its ``times`` says, which ``nth`` from 0 replaces.

    Rows repeated more than ``UNROLLED`` times are first dealt to tasks in pieces of that many.
    """
    kept = [c for c in rows.columns if c != times]
    span = lambda first, last: F.explode(F.sequence(first, last)).alias(nth)
    zero, n = F.lit(0).cast("long"), F.col(times)
    few = rows.where((n > 0) & (n <= UNROLLED)).select(*kept, span(zero, n - 1))
    pieces = rows.where(n > UNROLLED).select("*", F.explode(F.sequence(zero, F.floor((n - 1) / UNROLLED))).alias("_piece")).repartition("_piece")
    first = F.col("_piece") * UNROLLED
    return few.unionByName(pieces.select(*kept, span(first, F.least(first + UNROLLED, n) - 1)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def uniform(*parts: Column) -> Column:
    """Reproducible number in [0, 1) drawn from the hash of ``parts``."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_fs(uri: str):
    """(file system, path) of a URI, for Python tasks that read or write archive files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
