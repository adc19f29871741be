"""Continuous ingest: micro-batches checked against everything ever accepted."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from firstseen.plans.tables import TableSource, check_columns, check_mode, decide_rows, hash_rows, write_accepted
from firstseen.state.folder import Folder
from firstseen.state.store import State
from firstseen.workspace import discard, fresh_folder


def _claim_writer(state: State, writer: str, checkpoint: str) -> None:
    """Tie a writer name to one checkpoint.

    Batch numbers restart with a fresh checkpoint, and a run of the same number
    would overwrite what the ledger remembers.
    """
    if writer in ("batch", "compact") or "/" in writer or "=" in writer:
        raise ValueError(f"{writer!r} cannot name a streaming writer")
    mark = f"streams/{writer}"
    if not state.folder.exists(mark):
        state.folder.write_once(mark, {"checkpoint": checkpoint})
        return
    owner = state.folder.read(mark)["checkpoint"]
    started = Folder(state.spark, checkpoint).exists("metadata")
    if owner != checkpoint or (state.next_run(writer) > 0 and not started):
        raise ValueError(f"writer {writer!r} belongs to checkpoint {owner}; use a new name for a new checkpoint")


def ingest_stream(
    stream: DataFrame,
    as_files: Callable[[DataFrame], TableSource],
    state_dir: str,
    writer: str,
    checkpoint: str,
    sink: str,
    dest_template: str | None = None,
    *,
    mode: str = "copy",
    globs: Sequence[str] = (),
    ignore_hidden: bool = False,
    override: bool = False,
    existing: DataFrame | None = None,
    local_tz: str | None = None,
    compact_every: int = 10,
    trigger: dict | None = None,
    on_batch: Callable[[int, dict[str, int]], None] | None = None,
) -> StreamingQuery:
    """Start the query; ``as_files`` says how to read a batch as a set of files.

    Backpressure is the source's own limit (``maxFilesPerTrigger``) with the
    trigger given here, by default ``availableNow``. Every batch runs the same
    operators as a batch run, without the hash cache: a stream delivers a row
    once. A batch is idempotent. It hides its own earlier attempt from the ledger
    it reads, overwrites its output folder, and writes the ledger last.
    Paths must be unique within a batch. While a query runs, no other writer may
    use the same state. ``on_batch`` is called with the batch number and the counters of the batch.
    """
    check_mode(mode, dest_template)
    spark = stream.sparkSession
    tz = local_tz or spark.conf.get("spark.sql.session.timeZone")
    state = State(spark, state_dir)
    _claim_writer(state, writer, checkpoint)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        source = as_files(batch).selected(globs, ignore_hidden)
        check_columns(source.table, dest_template if mode == "copy" else None)
        folder = fresh_folder(batch.sparkSession, f"stream-{writer}-{batch_id}")
        rows = hash_rows(source, None, folder)
        known = state.ledger(replaying=(writer, batch_id))
        decided, additions, counts = decide_rows(
            rows, known, source.root, mode, dest_template, tz, existing, override, folder
        )
        if mode == "copy":
            write_accepted(source, decided, dest_template, tz, f"{sink}/writer={writer}/batch_id={batch_id}")
        state.append_ledger(additions, writer, batch_id, replay=True)
        discard(batch.sparkSession, folder)
        if compact_every and batch_id % compact_every == compact_every - 1:
            state.tend_ledger({writer: batch_id})
        if on_batch is not None:
            on_batch(batch_id, counts.get)

    return (
        stream.writeStream.foreachBatch(run_batch)
        .option("checkpointLocation", checkpoint)
        .queryName(writer)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
