"""Change classification against the hash cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstseen.schemas import MODIFIED, NEW, UNCHANGED


def spread_key(rows: DataFrame) -> Column:
    """``path_hash``, or for rows without a path a short stand-in that equals no digest.

    NULL keys would all meet in one task of a join; the stand-in depends on the
    other columns, so it spreads them and is the same in a retried task.
    """
    others = [c for c in rows.columns if c not in ("path_hash", "path_bytes")]
    return F.coalesce(F.col("path_hash"), F.unhex(F.hex(F.xxhash64(*others))))


def with_path(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Left-join ``found``, unique by ``path_hash``, to all rows."""
    right = found.withColumnRenamed("path_hash", "_key")
    return rows.withColumn("_key", spread_key(rows)).join(right, "_key", "left").drop("_key")


def classify(manifest: DataFrame, cache: DataFrame) -> DataFrame:
    """Left join on the path digest; append ``cache_result`` and ``cached_hash``.

    A path is unchanged when size, modification time and creation time all
    equal the cached ones, modified when any differs, new when it is not cached.
    Keys are unique digests on both sides, so the join cannot skew.
    """
    known = cache.select(
        "path_hash",
        F.struct("size", "mtime_ns", "ctime_ns").alias("_cached"),
        F.col("content_hash").alias("_cached_hash"),
    )
    same = F.struct("size", "mtime_ns", "ctime_ns") == F.col("_cached")
    result = (
        F.when(F.col("_cached").isNull(), F.lit(NEW))
        .when(same, F.lit(UNCHANGED))
        .otherwise(F.lit(MODIFIED))
    )
    return (
        with_path(manifest, known)
        .withColumn("cache_result", result)
        .withColumn("cached_hash", F.when(F.col("cache_result") == UNCHANGED, F.col("_cached_hash")))
        .drop("_cached", "_cached_hash")
    )


def classify_without_cache(manifest: DataFrame) -> DataFrame:
    """No-cache mode: nothing is looked up and every row counts as new."""
    return manifest.withColumn("cache_result", F.lit(NEW)).withColumn(
        "cached_hash", F.lit(None).cast("binary")
    )


def misses(classified: DataFrame) -> DataFrame:
    """Rows whose content must be read; rows in error are not read."""
    ok = F.col("error").isNull() if "error" in classified.columns else F.lit(True)
    return classified.filter((F.col("cache_result") != UNCHANGED) & ok)


def resolve_digest(rows: DataFrame) -> DataFrame:
    """Replace ``cached_hash`` and ``fresh_hash`` by the ``content_hash`` that
    counts: the cached one of an unchanged file, else the one just computed."""
    cached = F.col("cache_result") == UNCHANGED
    return rows.withColumn("content_hash", F.when(cached, F.col("cached_hash")).otherwise(F.col("fresh_hash"))).drop(
        "cached_hash", "fresh_hash"
    )
