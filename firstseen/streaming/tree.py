"""Continuous ingest of a source tree: the file run over what came or changed."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from firstseen.plans.files import FileRun, ingest_manifest
from firstseen.plans.tables import COMPACT_RUNS, check_mode
from firstseen.schemas import MANIFEST
from firstseen.sources.tree import FILE
from firstseen.sources.watch import SETTLE_MS, watch_tree
from firstseen.state.store import State
from firstseen.workspace import discard, fresh_folder, stage


def ingest_tree(
    spark: SparkSession,
    source: str,
    dest_template: str | None,
    state_dir: str,
    checkpoint: str,
    *,
    mode: str = "copy",
    globs: Sequence[str] = (),
    ignore_hidden: bool = False,
    settle_ms: int = SETTLE_MS,
    compact_every: int = 10,
    trigger: dict | None = None,
    on_batch: Callable[[int, FileRun], None] | None = None,
    **options,
) -> StreamingQuery:
    """Start the query; ``options`` are those of ``ingest_files`` for reading and placing.

    A batch classifies its files against the hash cache, so one that is delivered again is
    unchanged and not read. A batch that is run again redoes its unfinished run, or finds all
    it placed known. Vanished paths are pruned by batch runs with ``cleanup``. While the query
    runs, no batch run and no other stream may use the state. A batch without files is no run.
    """
    check_mode(mode, dest_template)
    if unknown := options.keys() - {"override", "copy_mode", "chunk_bytes", "threads", "local_tz"}:
        raise TypeError(f"unknown options {sorted(unknown)}")
    if dest_template is not None:
        # The working directory may change while the query runs.
        dest_template = os.path.join(os.getcwd(), dest_template)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        folder = fresh_folder(session, f"tree-{batch_id}")
        files = stage(batch.filter(F.col("kind") == FILE).select(MANIFEST.fieldNames()), "listed", folder)
        if not files.isEmpty():
            run = ingest_manifest(
                files, source, dest_template, state_dir, mode=mode, cleanup=False, resume=True, **options
            )
            if on_batch is not None:
                on_batch(batch_id, run)
        discard(session, folder)
        if compact_every and batch_id % compact_every == compact_every - 1:
            State(session, state_dir).tend_ledger(runs=COMPACT_RUNS)

    listed = watch_tree(spark, source, globs, ignore_hidden, settle_ms=settle_ms)
    return (
        listed.writeStream.foreachBatch(run_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
