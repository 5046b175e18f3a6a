"""Connected components by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.operators.store import settled


def _lowest(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) with ``low``, the least of a and all its b. Minima are written first, so a hot node's rows can be split."""
    low = settled(edges.groupBy("a").agg(F.min("b").alias("low")))
    return edges.join(low.select("a", F.least("a", "low").alias("low")), "a")


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("mark")).first()
    return row["n"], int(row["mark"] or 0)


def components(edges: DataFrame) -> DataFrame:
    """idx, root (the least idx that edges lead to) of all nodes of ``edges`` (a, b: long) but the roots themselves.

    In turn, each node hands its larger neighbours to its least one, and its smaller ones; both
    steps keep the components and shorten all ways to their least node, so the rounds are about
    the logarithm of the longest way. Only a count and a checksum come to the driver.
    """
    edges = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while mark != (mark := _mark(edges)):
        both = settled(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        large = _lowest(both).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = settled(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        small = _lowest(large)
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(small.select("a", F.col("low").alias("b")))
        edges = settled(small.where("a <> b").distinct())
    return edges.select(F.col("a").alias("idx"), F.col("b").alias("root"))
