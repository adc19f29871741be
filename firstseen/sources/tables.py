"""Any table with a key, a payload and a modification time as a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstseen.functions import digest, paths


def manifest(
    table: DataFrame,
    path: Column,
    payload: Column,
    mtime_ns: Column,
    root: str,
    ctime_ns: Column | None = None,
    size: Column | None = None,
    with_digest: bool = False,
    source_file: Column | None = None,
    source_row: Column | None = None,
) -> DataFrame:
    """Narrow manifest rows of a table; the payload itself is not carried.

    ``size`` may name a stored length, which keeps the payload column out of the
    scan entirely. With ``with_digest`` the digest is taken where the payload is
    read, so only 32 bytes per row ever leave the scan. ``source_file`` and
    ``source_row`` add the stored file of a row and its number there.
    """
    columns = [
        path.alias("path"),
        path.cast("binary").alias("path_bytes"),
        digest.path_digest(path).alias("path_hash"),
        paths.relative_path(path, root).alias("rel_path"),
        (F.octet_length(payload) if size is None else size).cast("bigint").alias("size"),
        mtime_ns.cast("bigint").alias("mtime_ns"),
        F.coalesce(F.lit(None) if ctime_ns is None else ctime_ns, F.lit(0)).cast("bigint").alias("ctime_ns"),
    ]
    if with_digest:
        columns.append(digest.content_digest(payload).alias("content_hash"))
    if source_file is not None:
        columns.append(source_file.alias("source_file"))
    if source_row is not None:
        columns.append(source_row.alias("source_row"))
    return table.select(*columns)
