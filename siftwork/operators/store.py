"""Tables that several jobs of one operator read are written once, as Parquet, below the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and all its processes are on one machine, as in tests.
FALLBACK = "file:///tmp/checkpoints/siftwork"
#: Folders that this process was given.
_MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder in ``spark.checkpoint.dir``; a path without a scheme is one of the default file system."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver can reach")
        return FALLBACK
    if "://" in base:
        return base.rstrip("/")
    if base.startswith("file:"):
        return f"file://{base.removeprefix('file:').rstrip('/')}"
    system = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return ("file://" if system.startswith("file:") else system.rstrip("/")) + "/" + base.strip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder in the shared one.

    Nothing is created here. All processes of the job can reach the folder, so what is
    written there outlives a lost executor.
    """
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def clear_workspaces() -> None:
    """Removes this process's folders. Results read from them can't be read any more; it runs by itself when the driver's Python ends."""
    from pyarrow import fs

    while _MADE:
        with contextlib.suppress(OSError):
            system, root = fs.FileSystem.from_uri(_MADE.pop())
            system.delete_dir(root)


atexit.register(clear_workspaces)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and return the table read back: its lineage ends at the files, and later scans prune and push down."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to a folder of its own: a lost executor costs nothing but a read."""
    return materialize(df, workspace(df.sparkSession, "settled"))
