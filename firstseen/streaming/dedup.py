"""Streaming exact dedup: emit the first row of every content, forever."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Spark's option for the state store, and the store that keeps its state on disk.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def check_state_store(spark: SparkSession) -> None:
    """Fail where state that never expires would be kept in memory."""
    if spark.conf.get(STATE_STORE) != ROCKSDB:
        raise ValueError(f"set {STATE_STORE} to {ROCKSDB}")


def _first_in_batch(batches):
    """Drop repeats within each Arrow batch; memory is one batch."""
    for batch in batches:
        seen: set[bytes] = set()
        keep = []
        for value in batch.column(batch.schema.get_field_index("content_hash")).to_pylist():
            keep.append(value is not None and value not in seen)
            seen.add(value)
        if any(keep):
            yield batch.filter(pa.array(keep, type=pa.bool_()))


def first_seen(rows: DataFrame) -> DataFrame:
    """First row per ``content_hash`` over the life of the query.

    The memory never expires, so there is no watermark and the state belongs on
    disk: the session's state store must be RocksDB when the query starts. A hot content is thinned inside the scan tasks before the shuffle:
    each batch of rows passes on at most one row per content. Rows without a
    digest are dropped. Pass narrow rows, not payloads.
    """
    check_state_store(rows.sparkSession)
    return rows.mapInArrow(_first_in_batch, rows.schema).dropDuplicates(["content_hash"])
