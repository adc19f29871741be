"""Scan filters on manifest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstseen.functions import globs as glob_rules
from firstseen.functions import paths


def select_files(manifest: DataFrame, globs: Sequence[str] = (), ignore_hidden: bool = False) -> DataFrame:
    """Rows that the include / exclude globs and the hidden rule keep."""
    return manifest.filter(glob_rules.keeps_file(F.col("rel_path"), globs, ignore_hidden))


def row_error() -> Column:
    """First reason why a manifest row cannot be processed, NULL when none.

    The checks are ordered as the stages that raise them: times before 1970,
    then the absolute-path rule, then the source root.
    """
    return (
        F.when(F.col("ctime_ns") < 0, F.lit("creation time is before 1970"))
        .when(F.col("mtime_ns").isNull(), F.lit("no modification time"))
        .when(F.col("mtime_ns") < 0, F.lit("modification time is before 1970"))
        .when(F.col("path").isNull() | ~paths.is_absolute(F.col("path")), F.lit("path must be absolute"))
    )


def with_errors(manifest: DataFrame) -> DataFrame:
    """Append ``error``; an error the source already reported wins."""
    own = F.col("error") if "error" in manifest.columns else F.lit(None).cast("string")
    return manifest.withColumn("error", F.coalesce(own, row_error()))
