"""Table scans and event history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv", "text")


def table(spark: SparkSession, path: str, columns: list[str] | None = None, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Scan of files with only the columns asked for; formats without a schema of their own need one given."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    reader = spark.read.format(kind).options(**options)
    df = (reader.schema(schema) if schema else reader).load(path)
    return df.select(*columns) if columns else df


#: Estimated bytes from which on rows are worth dealing over the cores.
WORTH = 1 << 20


def spread(df: DataFrame, worth: int = WORTH) -> DataFrame:
    """``df`` dealt over all cores if its scan has fewer partitions than there are and ``worth`` bytes or more, for work that outweighs a shuffle of the rows.

    Files of one row group are read by one task, however large. At scale a scan has more
    partitions than cores, and this does nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size >= worth and df.rdd.getNumPartitions() < cores else df


#: Rows that a task of a join has at most, unless one key has more.
TASK_ROWS = 500_000


def dealt(large: DataFrame, key: str, *others: DataFrame, most: int = TASK_ROWS) -> list[DataFrame]:
    """``large`` and ``others`` dealt by ``key`` to as many tasks as the rows of ``large`` need, if a shuffle has fewer: what a task sorts doesn't grow with the input.

    The rows are counted by a job of their own, which reads no column of a plain scan.
    """
    tasks = -(-large.count() // most)
    more = tasks > int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return [df.repartition(tasks, key) if more else df for df in (large, *others)]


def relational(spark: SparkSession, url: str, name: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
    """Scan of a database table, split by a key's range. The driver class must be on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def history(events: DataFrame, entity, limit: int | None = None, key: str = "entity_id", order: str = "seq") -> DataFrame:
    """Events of an entity in order."""
    rows = events.where(F.col(key) == entity).orderBy(order)
    return rows.limit(limit) if limit else rows


def replay(events: DataFrame, entity, after=None, key: str = "entity_id", order: str = "seq") -> DataFrame:
    """Events of an entity behind a given one, by a filter that the scan can take; none if that one isn't known."""
    rows = events.where(F.col(key) == entity)
    if after is None:
        return rows.orderBy(order)
    known = rows.where(F.col(order) == after).limit(1).count()
    return rows.where(F.col(order) > after if known else F.lit(False)).orderBy(order)
