"""Upserts and deletes on the hash cache, as joins on the path digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstseen.schemas import CACHE

_COLUMNS = CACHE.fieldNames()


def cached_paths(cache: DataFrame) -> DataFrame:
    return cache.select("path_bytes")


def cached_path_count(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("cached_paths"))


def cache_entries(hashed: DataFrame) -> DataFrame:
    """Cache rows for the files that were read in this run."""
    return hashed.filter(F.col("content_hash").isNotNull() & (F.col("cache_result") != "unchanged")).select(*_COLUMNS)


def listed_entries(hashed: DataFrame) -> DataFrame:
    """Cache rows for all files of a run that have a digest.

    For an unchanged file this is the row the cache already holds, so upserting
    them all equals upserting the files that were read.
    """
    return hashed.filter(F.col("content_hash").isNotNull()).select(*_COLUMNS)


def upsert(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Replace or insert by path digest."""
    kept = cache.join(entries.select("path_hash"), "path_hash", "left_anti")
    return kept.select(*_COLUMNS).unionByName(entries.select(*_COLUMNS))


def delete(cache: DataFrame, gone: DataFrame) -> DataFrame:
    """Remove the given path digests."""
    return cache.join(gone.select("path_hash"), "path_hash", "left_anti").select(*_COLUMNS)


def layer(rows: DataFrame, gone: bool) -> DataFrame:
    """Rows of a layer of the stored cache: entries, or the path digests of removed ones."""
    known = {name: F.col(name) for name in rows.columns}
    columns = [known.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in CACHE.fields]
    return rows.select(*columns, F.lit(gone).alias("gone"))


def newest(layers: DataFrame) -> DataFrame:
    """One row per path of several layers, the newest layer's; a full layer has no ``gone``.

    The aggregation leaves the rows partitioned by path digest, as the joins on the cache want them.
    """
    row = F.struct(*_COLUMNS[1:], F.coalesce("gone", F.lit(False)).alias("gone"))
    latest = layers.groupBy("path_hash").agg(F.max_by(row, "snapshot").alias("row"))
    return latest.select("path_hash", "row.*")


def left_over(layer: DataFrame) -> DataFrame:
    """Entries of a merge that went down to the oldest layer."""
    return layer.filter("not gone").select(*_COLUMNS)


def mark_present(cache: DataFrame, present: DataFrame, root: str = "/") -> DataFrame:
    """Append ``present`` from the full set of existing paths below ``root``.

    The set must not be narrowed by globs: an entry that is missing from it is
    taken for a vanished path. Entries outside ``root`` are not checked; their
    ``present`` is NULL.
    """
    flags = present.select("path_hash").withColumn("_there", F.lit(True))
    inside = F.startswith(F.col("path_bytes").cast("string"), F.lit(root.rstrip("/") + "/"))
    return (
        cache.join(flags, "path_hash", "left")
        .withColumn("present", F.when(inside, F.coalesce("_there", F.lit(False))))
        .drop("_there")
    )


def keep_present(marked: DataFrame) -> DataFrame:
    """Drop vanished entries; a failed check (NULL) keeps the entry."""
    return marked.filter(F.coalesce(F.col("present"), F.lit(True))).select(*_COLUMNS)


def cleanup_metrics() -> list[Column]:
    """Entries checked and removed, as aggregates over marked rows."""
    gone = ~F.coalesce(F.col("present"), F.lit(True))
    return [
        F.count(F.lit(1)).cast("bigint").alias("checked"),
        F.count_if(gone).cast("bigint").alias("removed"),
    ]


def cleanup_counts(marked: DataFrame) -> DataFrame:
    return marked.agg(*cleanup_metrics())
