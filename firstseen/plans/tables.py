"""Batch ingest of a table: key, payload, modification time.

The payload is read where it is stored. Only digests and narrow columns are
shuffled; accepted payloads go from the source scan to the sink.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firstseen.functions import digest, paths, template
from firstseen.functions.globs import keeps_file
from firstseen.operators import cache as cache_ops
from firstseen.operators import classify as classify_ops
from firstseen.operators import content, filters, ledger, payload, stats
from firstseen.schemas import COPIED, FAILED, SKIPPED, UNCHANGED
from firstseen.sources import tables
from firstseen.state.folder import Folder
from firstseen.state.store import State, now_ms
from firstseen.workspace import discard, fresh_folder, setting, stage

# Ledger runs that may pile up before a run folds them.
COMPACT_RUNS = 8


@dataclass(frozen=True)
class TableSource:
    """How to read a table as a set of files."""

    table: DataFrame
    path: Column
    payload: Column
    mtime_ns: Column
    root: str
    ctime_ns: Column | None = None
    size: Column | None = None

    def manifest(self, with_digest: bool = False, with_file: bool = False) -> DataFrame:
        """Manifest rows; ``with_file`` adds the stored file of a row and its number there, if the table has them."""
        place = [
            F.col(f"_metadata.{field}") if with_file and payload.has_metadata(self.table, field) else None
            for field in ("file_path", "row_index")
        ]
        return tables.manifest(
            self.table, self.path, self.payload, self.mtime_ns, self.root, self.ctime_ns, self.size, with_digest, *place
        )

    def selected(self, globs: Sequence[str], ignore_hidden: bool) -> TableSource:
        """The source reduced to the rows that the scan filters keep."""
        if not globs and not ignore_hidden:
            return self
        rel = paths.relative_path(self.path, self.root)
        # A row without a relative path stays, so that it is reported as failed.
        return replace(self, table=self.table.filter(rel.isNull() | keeps_file(rel, globs, ignore_hidden)))

    def keyed(self) -> DataFrame:
        """All source columns plus the row key, for fetching payloads."""
        return self.table.withColumn(payload.KEY, digest.path_digest(self.path))

    def candidates(self, rows: DataFrame, wanted: Column) -> DataFrame:
        """Keyed source rows among which all wanted ones are; ``rows`` is staged.

        By row numbers, these are the wanted ones and no others, if one wave holds them.
        """
        read = replace(self, table=payload.files_with(self.table, rows, wanted))
        if payload.ROW in rows.columns and payload.waves_for(rows, wanted) == 1:
            return replace(read, table=payload.picked(read.table, rows, wanted)).keyed()
        return payload.thinned(read.keyed(), rows, wanted)

    def waves(self, rows: DataFrame, wanted: Column) -> list[DataFrame]:
        """The same, one frame for each wave of files; only without row numbers other rows may be among them."""
        if payload.ROW not in rows.columns:
            return [self.candidates(rows, wanted)]
        table, waves = payload.files_with(self.table, rows, wanted), payload.waves_for(rows, wanted)
        return [replace(self, table=payload.picked(table, rows, wanted, i, waves)).keyed() for i in range(waves)]


@dataclass
class TableRun:
    """What one run did. ``accepted`` holds whole source rows."""

    results: DataFrame
    stats: DataFrame
    accepted: DataFrame


def digests_of_misses(source: TableSource, classified: DataFrame, folder: str | None = None) -> DataFrame:
    """(path_hash, content_hash) of the rows that must be read; ``classified`` is staged.

    Only files that hold a miss are read, and of their rows only the misses are digested.
    Several waves are staged one after the other. Without row numbers, rows that pass by the
    prefix of their key alone are digested as well.
    """
    taken = [F.col(payload.KEY).alias("path_hash"), digest.content_digest(source.payload).alias("content_hash")]
    ok = F.col("error").isNull() if "error" in classified.columns else F.lit(True)
    digests = [read.select(*taken) for read in source.waves(classified, (F.col("cache_result") != UNCHANGED) & ok)]
    if len(digests) == 1:
        return digests[0]
    return reduce(DataFrame.unionByName, [stage(wave, f"digests-{i}", folder) for i, wave in enumerate(digests)])


def hash_rows(source: TableSource, cache: DataFrame | None, folder: str | None = None) -> DataFrame:
    """CORE rows of a source with ``cache_result`` and ``content_hash``.

    The payload is scanned at most once. If the table stores payload sizes, rows
    are classified without it and only the misses are read. If a size has to be
    measured, the same scan takes the digest.
    """
    if cache is not None and source.size is not None:
        chosen = filters.with_errors(source.manifest(with_file=True)).drop("path", "rel_path")
        classified = stage(classify_ops.classify(chosen, cache), "classified", folder)
        fresh = digests_of_misses(source, classified, folder).withColumnRenamed("content_hash", "fresh_hash")
        rows = classify_ops.with_path(classified, fresh)
    else:
        chosen = filters.with_errors(source.manifest(with_digest=True, with_file=True))
        chosen = chosen.drop("path", "rel_path").withColumnRenamed("content_hash", "fresh_hash")
        if cache is None:
            rows = classify_ops.classify_without_cache(chosen)
        else:
            rows = classify_ops.classify(chosen, cache)
    hashed = classify_ops.resolve_digest(rows)
    missing = F.col("content_hash").isNull() & F.col("error").isNull()
    return hashed.withColumn("error", F.when(missing, F.lit("no payload")).otherwise(F.col("error"))).withColumn(
        "content_hash", F.when(F.col("error").isNull(), F.col("content_hash"))
    )


def _path() -> Column:
    return paths.display(F.col("path_bytes"))


def _dest(root: str, dest_template: str, tz: str) -> Column:
    return template.destination(dest_template, F.col("mtime_ns"), paths.relative_path(_path(), root), tz)


def place(
    hashed: DataFrame,
    root: str,
    dest_template: str,
    tz: str,
    existing: DataFrame | None = None,
    override: bool = False,
) -> DataFrame:
    """Append ``eligible``, and ``error`` for rows that cannot be placed."""
    rows = hashed.withColumn("dest_path", _dest(root, dest_template, tz))
    if existing is None or override:
        rows = rows.withColumn("dest_exists", F.lit(False))
    else:
        rows = content.destination_conflicts(rows, existing)
    reason = (
        F.when(paths.relative_path(_path(), root).isNull(), F.lit("path is outside the source root"))
        .when(F.col("dest_path").isNull(), F.lit("destination cannot be rendered"))
        .when(F.col("dest_exists"), F.lit("destination already exists"))
    )
    return (
        rows.withColumn("error", F.coalesce(F.col("error"), reason))
        .withColumn("eligible", F.col("error").isNull())
        .drop("dest_path", "dest_exists")
    )


def describe(decided: DataFrame, root: str, dest_template: str | None, tz: str) -> DataFrame:
    """Result rows: derived paths are added, reasons stay on failed rows only."""
    dest = F.lit(None).cast("string") if dest_template is None else _dest(root, dest_template, tz)
    return decided.select(
        _path().alias("path"), paths.relative_path(_path(), root).alias("rel_path"), "path_hash", "size",
        "mtime_ns", "ctime_ns", "content_hash", "cache_result", "outcome", dest.alias("dest_path"),
        F.when(F.col("outcome") == FAILED, F.col("error")).alias("error"),
    )


def load_outcome(hashed: DataFrame) -> DataFrame:
    """Load mode: every readable row counts as skipped, nothing is placed."""
    ok = F.col("content_hash").isNotNull()
    return hashed.withColumn("outcome", F.when(ok, F.lit(SKIPPED)).otherwise(F.lit(FAILED)))


def ingest_table(
    source: TableSource,
    state_dir: str,
    dest_template: str | None = None,
    *,
    mode: str = "copy",
    cleanup: bool = True,
    use_cache: bool = True,
    globs: Sequence[str] = (),
    ignore_hidden: bool = False,
    override: bool = False,
    existing: DataFrame | None = None,
    local_tz: str | None = None,
    sink: str | None = None,
    resume: bool = False,
    caller_stores: bool = False,
) -> TableRun:
    """Run one batch. The cache is written first, then the data, the ledger last.

    Contents are remembered as accepted, so they must be stored: by ``sink``, or
    by the caller, who then says so with ``caller_stores=True``.
    Paths must be unique within the table. A run that crashed before it stored
    anything is taken over by the next one, which finds its digests in the cache.
    After a later crash ``resume=True`` redoes the unfinished run; its output
    folder is overwritten. The sink has one folder level for every token of the
    template, by the token's name (``year_utc=2024``).
    """
    check_mode(mode, dest_template)
    if mode == "copy" and sink is None and not caller_stores:
        raise ValueError("copy mode needs a sink, or caller_stores=True if the caller has stored every unseen row")
    check_columns(source.table, dest_template if sink is not None else None)
    spark = source.table.sparkSession
    tz = local_tz or spark.conf.get("spark.sql.session.timeZone")
    state = State(spark, state_dir)
    run_id = state.open_run(resume)
    folder = fresh_folder(spark, "table-run")

    whole, source = source, source.selected(globs, ignore_hidden)
    rows = hash_rows(source, state.cache() if use_cache else None, folder)
    decided, additions, counts = decide_rows(
        rows, state.ledger(), source.root, mode, dest_template, tz, existing, override, folder
    )
    _maintain_cache(state, whole, decided, use_cache, cleanup)
    state.mark_placing(run_id)
    if sink is not None and mode == "copy":
        accepted = write_accepted(source, decided, dest_template, tz, f"{sink}/run_id={run_id}")
    else:
        accepted = accepted_rows(source, decided)
    state.append_ledger(additions, run_id=run_id)
    state.close_run(run_id)
    if cleanup:
        state.tend_ledger(runs=COMPACT_RUNS)
    # The frames returned below read "decided" only.
    for name in Folder(spark, folder).subfolders(""):
        if name != "decided":
            discard(spark, f"{folder}/{name}")
    results = describe(decided, source.root, dest_template if mode == "copy" else None, tz)
    return TableRun(results, stats.observed(spark, counts.get), accepted)


def check_columns(table: DataFrame, sink_template: str | None) -> None:
    """A source's own columns are never overwritten: clashing names are refused."""
    folders = [] if sink_template is None else [name for name, _ in layout(sink_template, F.lit(0), "UTC")]
    reserved = {*payload.OWN, _DATE, _SLOT, "_slots", *folders}
    clashing = sorted(c for c in table.columns if c.lower() in reserved)
    if clashing:
        raise ValueError(f"rename the columns {clashing}: these names are used by the run")


def check_mode(mode: str, dest_template: str | None) -> None:
    if mode not in ("copy", "load"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "copy" and dest_template is None:
        raise ValueError("dest_template is required unless mode='load'")


def decide_rows(
    hashed: DataFrame,
    known: DataFrame,
    root: str,
    mode: str,
    dest_template: str | None,
    tz: str,
    existing: DataFrame | None,
    override: bool,
    folder: str,
) -> tuple[DataFrame, DataFrame, Observation]:
    """Staged rows with ``outcome``, the ledger entries they add, the counters.

    Rows are staged before the decision, which reads them twice, and after it,
    so that sink, cache and ledger all see the same outcome. The counters are
    observed while the outcome is written.
    """
    watch = Observation()
    if mode == "load":
        decided = stage(load_outcome(hashed).observe(watch, *stats.counters()), "decided", folder)
        require_unique_paths(decided)
        memory = ledger.relevant(known, decided)
        return decided, ledger.new_entries(decided, memory, now_ms()), watch
    placed = stage(place(hashed, root, dest_template, tz, existing, override), "placed", folder)
    require_unique_paths(placed)
    known = ledger.relevant(known, placed)
    decided = stage(content.decide(placed, known).observe(watch, *stats.counters()), "decided", folder)
    return decided, ledger.entries(decided.filter(F.col("outcome") == COPIED), now_ms()), watch


def require_unique_paths(rows: DataFrame) -> None:
    repeated = rows.filter(F.col("path_hash").isNotNull()).groupBy("path_hash").count().filter("count > 1")
    if not repeated.isEmpty():
        raise ValueError("the path column is not unique")


def _maintain_cache(state: State, whole: TableSource, hashed: DataFrame, use_cache: bool, cleanup: bool) -> None:
    """One layer holds the entries that changed and the paths that vanished.

    Rows of this run exist; only the other entries are held against the whole
    source, which the scan filters do not narrow.
    """
    if not use_cache and not cleanup:
        return
    changed = cache_ops.cache_entries(hashed) if use_cache else None
    gone = None
    if cleanup:
        others = cache_ops.delete(state.cache(), cache_ops.listed_entries(hashed)) if use_cache else state.cache()
        present = whole.keyed().select(F.col(payload.KEY).alias("path_hash"))
        gone = cache_ops.mark_present(others, present, whole.root).filter("not present")
    state.change_cache(changed, gone)


# The date of a row as one key, and what one task of the sink takes.
_DATE, _SLOT = "_firstseen_date", "_firstseen_slot"
# Lets two sides that are partitioned by some of their join keys meet as they are.
CO_PARTITION = ("spark.sql.requireAllClusterKeysForCoPartition", "false")
# Payload bytes of one date of the sink that one task writes.
SLOT_BYTES = 128 << 20


def layout(dest_template: str, mtime_ns: Column, tz: str) -> list[tuple[str, Column]]:
    """The folders of the sink: one level for every token of the template, by its name."""
    return [
        (token.strip("{}"), template.token_value(token, mtime_ns, tz).cast("int"))
        for token in template.tokens_in(dest_template)
    ]


def accepted_rows(source: TableSource, decided: DataFrame) -> DataFrame:
    """Source rows that were accepted, payload included; ``decided`` is staged."""
    wanted = F.col("outcome") == COPIED
    return payload.exactly(source.candidates(decided, wanted), decided, wanted).drop(payload.KEY)


def accepted_by_slot(source: TableSource, decided: DataFrame, dest_template: str, tz: str) -> DataFrame:
    """Accepted rows and their folder columns, partitioned for the sink; ``decided`` is staged.

    Payloads are shuffled once. Every row has a slot, its date and one of as many
    buckets as the bytes of that date need; rows and keys meet by slot, and a
    slot is written by one task. A date with most of the rows has many slots.
    """
    wanted = F.col("outcome") == COPIED
    folders = layout(dest_template, source.mtime_ns.cast("bigint"), tz)
    names = [name for name, _ in folders]

    def dated(rows: DataFrame, levels: list[tuple[str, Column]]) -> DataFrame:
        return rows.withColumns(dict(levels)).withColumn(_DATE, F.xxhash64(F.lit(0), *names))

    keyed = dated(decided, layout(dest_template, F.col("mtime_ns"), tz))
    need = F.greatest(F.lit(1), F.ceil(F.sum("size") / SLOT_BYTES)).cast("bigint").alias("_slots")
    # One row per date: file times are 64-bit nanoseconds, so the dates number 106,752 at
    # most, three times that if the template mixes UTC and local tokens.
    dates = F.broadcast(keyed.filter(wanted).groupBy(_DATE).agg(need))

    def slotted(rows: DataFrame, key: str) -> DataFrame:
        slot = F.xxhash64(_DATE, F.pmod(F.xxhash64(key), F.col("_slots")))
        return rows.join(dates, _DATE).withColumn(_SLOT, slot).drop("_slots", _DATE)

    rows = slotted(dated(source.candidates(decided, wanted), folders), payload.KEY).repartition(_SLOT)
    return payload.exactly(rows, slotted(keyed, "path_hash"), wanted, _SLOT).drop(payload.KEY, _SLOT)


def write_accepted(source: TableSource, decided: DataFrame, dest_template: str, tz: str, folder: str) -> DataFrame:
    """Write the accepted rows below folders named by the template's tokens.

    Returns the written rows, with the columns of the source.
    """
    spark = decided.sparkSession
    names = [name for name, _ in layout(dest_template, source.mtime_ns, tz)]
    accepted = accepted_by_slot(source, decided, dest_template, tz)
    # Both sides are partitioned by slot, which decides where a key goes: no second exchange.
    with setting(spark, *CO_PARTITION):
        accepted.write.mode("overwrite").partitionBy(*names).parquet(folder)
    schema = T.StructType([*source.table.schema.fields, *[T.StructField(name, T.IntegerType()) for name in names]])
    return spark.read.schema(schema).parquet(folder).drop(*names)
