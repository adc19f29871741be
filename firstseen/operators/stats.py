"""Counters of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firstseen.functions import paths
from firstseen.schemas import COPIED, FAILED, MODIFIED, NEW, SKIPPED, UNCHANGED


def _files_and_bytes(name: str, condition: Column) -> list[Column]:
    size = F.coalesce(F.sum(F.when(condition, F.col("size"))), F.lit(0))
    return [
        F.count_if(condition).cast("bigint").alias(f"{name}_files"),
        size.cast("bigint").alias(f"{name}_bytes"),
    ]


def counters() -> list[Column]:
    """Files and bytes per class and per outcome, as aggregates over results.

    Failed rows are in no counter but ``failed_files``.
    """
    done = F.col("outcome") != FAILED
    columns = _files_and_bytes("total", done)
    for value in (NEW, MODIFIED, UNCHANGED):
        columns += _files_and_bytes(value, done & (F.col("cache_result") == value))
    for value in (COPIED, SKIPPED):
        columns += _files_and_bytes(value, F.col("outcome") == value)
    return [*columns, F.count_if(F.col("outcome") == FAILED).cast("bigint").alias("failed_files")]


def observed(spark: SparkSession, metrics: dict[str, int]) -> DataFrame:
    """Observed counters as the one-row frame that :func:`ingest_stats` gives."""
    schema = ", ".join(f"{name} bigint" for name in metrics)
    return spark.createDataFrame([tuple(metrics.values())], schema)


def ingest_stats(results: DataFrame) -> DataFrame:
    """The counters of a run in one row."""
    return results.agg(*counters())


def scan_counts(manifest: DataFrame) -> DataFrame:
    """Files, distinct parent directories and bytes of a manifest.

    A manifest of files cannot show empty directories; the tree listing can.
    Counting happens per directory first, so no distinct set is collected.
    """
    per_directory = manifest.groupBy(paths.parent_dir(F.col("path")).alias("directory")).agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes")
    )
    return per_directory.agg(
        F.coalesce(F.sum("files"), F.lit(0)).cast("bigint").alias("n_files"),
        F.count("*").cast("bigint").alias("n_directories"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.coalesce(F.max("files"), F.lit(0)).cast("bigint").alias("largest_directory_files"),
    )


def failures(results: DataFrame) -> DataFrame:
    """The failed rows with their reasons."""
    return results.filter(F.col("outcome") == FAILED).select("path", "error")
