"""Where intermediate tables live.

A run evaluates some intermediate results more than once (the digests, the
decision). Those are written once as Parquet below the folder the cluster names
in ``spark.checkpoint.dir``: every executor can reach it, so losing an executor
costs neither the table nor a second read of the payload.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from firstseen.state.folder import Folder

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; a scratch one only on a local master."""
    context = spark.sparkContext
    configured = spark.conf.get(_CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_DIR} to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="firstseen-"))
    return context.getCheckpointDir().rstrip("/")


def mounted(folder: str) -> str:
    """The plain path of a shared folder that tasks open as a file system."""
    path = folder.removeprefix("file://").removeprefix("file:")
    if not path.startswith("/"):
        raise ValueError(f"{folder} is not on a mounted file system")
    return path


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/firstseen/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it back.

    The shuffles behind the table are deleted as soon as it is written: nothing
    reads them again, and else they stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{folder}/{label}" if folder else fresh_folder(spark, label)
    with setting(spark, _DROP_SHUFFLES, "true"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table, or all of a run's, that nothing reads any more."""
    parent, name = path.rsplit("/", 1)
    Folder(spark, parent).delete(name)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Set a session option for the queries planned inside the block."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)
