"""Path order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firstseen.functions import paths
from firstseen.workspace import stage

# Rows that are ranked in one task.
SLICE_ROWS = 1_000_000


def ordered(manifest: DataFrame) -> DataFrame:
    """Rows in component-wise path order: a range-partitioned global sort."""
    return manifest.orderBy(paths.order_key(F.col("path_bytes")))


def sibling_positions(manifest: DataFrame, slices: int | None = None) -> DataFrame:
    """Append ``position``, the 1-based rank of a file within its directory.

    A directory may hold a third of all files, so it must not become one window
    group. The rows are cut into slices along the path order and written once.
    Ranks are taken within (directory, slice) and shifted by the number of
    siblings in earlier slices, a prefix sum over one count per slice. The number
    of slices follows the number of rows.
    """
    spark = manifest.sparkSession
    if slices is None:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        slices = max(least, -(-manifest.count() // SLICE_ROWS))
    keyed = manifest.withColumn("_dir", paths.parent_dir(F.col("path"))).withColumn(
        "_key", paths.order_key(F.col("path_bytes"))
    )
    cut = keyed.repartitionByRange(slices, "_dir", "_key").withColumn("_slice", F.spark_partition_id())
    cut = stage(cut, "siblings")

    local = Window.partitionBy("_dir", "_slice").orderBy("_key")
    before = Window.partitionBy("_dir").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        cut.groupBy("_dir", "_slice")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        cut.withColumn("_rank", F.row_number().over(local))
        .join(shift, ["_dir", "_slice"])
        .withColumn("position", (F.col("_rank") + F.col("_before")).cast("bigint"))
        .drop("_dir", "_key", "_slice", "_rank", "_before")
    )
