"""Batch ingest of a source tree into a templated destination tree."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from firstseen.functions import digest, paths, template
from firstseen.operators import cache as cache_ops
from firstseen.operators import classify as classify_ops
from firstseen.operators import content, filters, ledger, payload, stats
from firstseen.plans.tables import COMPACT_RUNS, check_mode, load_outcome
from firstseen.schemas import CACHE, COPIED, CORE, FAILED, SKIPPED, UNCHANGED
from firstseen.sources.content import (
    CHUNK_BYTES,
    THREADS,
    copy_files,
    copy_in_turn,
    hash_files,
    probe,
    spread_by_bytes,
)
from firstseen.sources.tree import Listing, scan_tree
from firstseen.state.folder import Folder
from firstseen.state.store import State, now_ms
from firstseen.workspace import discard, fresh_folder, stage


@dataclass
class FileRun:
    """What one run did; ``removed`` counts vanished cache entries."""

    results: DataFrame
    stats: DataFrame
    checked: int
    removed: int
    listing: Listing | None = None


def _work_size(rows: DataFrame) -> tuple[int, int]:
    row = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def hash_misses(classified: DataFrame, folder: str, chunk_bytes: int, threads: int) -> DataFrame:
    """Read and digest the files that are new or modified, once.

    ``classified`` is staged, and so are the digests. The work is spread by a
    uniform key over tasks sized by bytes. Appends ``content_hash``; a file that
    cannot be read gets an ``error``.
    """
    unread = classify_ops.misses(classified)
    files, total = _work_size(unread)
    keys = spread_by_bytes(unread.select("path_hash", "path_bytes"), "path_hash", files, total)
    digests = hash_files(keys, chunk_bytes, threads).withColumnRenamed("content_hash", "fresh_hash")
    digests = stage(digests.drop("path_bytes"), "digests", folder)
    hashed = classify_ops.resolve_digest(classified.join(digests, "path_hash", "left"))
    return (
        hashed.withColumn("error", F.coalesce("error", "hash_error"))
        .withColumn("content_hash", F.when(F.col("error").isNull(), F.col("content_hash")))
        .drop("hash_error")
    )


def check_destinations(
    unseen: DataFrame, dest: Column, override: bool, trust_copy: bool, threads: int
) -> DataFrame:
    """Append ``eligible``, and ``error`` where a destination is taken.

    ``unseen`` is staged and holds content that is not known, the only kind
    whose destination matters. When a crashed run is redone the check is left to
    the copy, which accepts a target that already holds this row's bytes.
    """
    unplaced = F.when(dest.isNull(), F.lit("destination cannot be rendered"))
    rows = unseen.withColumn("error", F.coalesce("error", unplaced))
    if override or trust_copy:
        return rows.withColumn("eligible", F.col("error").isNull())
    wanted = F.when(F.col("error").isNull(), dest)
    spread = spread_by_bytes(rows.withColumn("_probe", wanted), "path_hash", unseen.count(), 0)
    taken = F.when(F.col("present"), F.lit("destination already exists")).otherwise(F.col("probe_error"))
    return (
        probe(spread, "_probe", threads)
        .withColumn("error", F.coalesce("error", taken))
        .withColumn("eligible", F.col("error").isNull())
        .drop("_probe", "present", "probe_error")
    )


def copy_winners(
    checked: DataFrame, dest: Column, folder: str, override: bool, how: str, chunk_bytes: int, threads: int
) -> DataFrame:
    """Decide, copy, and decide again for contents whose winner failed to copy.

    A failed copy records nothing, so the next file with the same content gets
    its turn. The first round copies one file per content. Later rounds take
    only contents without a good copy and try twice as many files of each as the
    round before, in order, so even a content all of whose files fail is
    settled after a logarithmic number of rounds. ``checked`` is staged and has
    ``known``. Returns it with ``outcome``.
    """
    settled: list[DataFrame] = []
    open_rows, turn = checked.withColumn("done", F.lit(False)), 0
    while True:
        decided = stage(content.decide(open_rows), f"decided-{turn}", folder)
        winners = decided.filter((F.col("outcome") == COPIED) & ~F.col("done"))
        files, total = _work_size(winners)
        if files == 0:
            settled.append(decided)
            break
        if turn == 0:
            spread = spread_by_bytes(_copy_work(winners, dest), "path_hash", files, total)
            tried = copy_files(spread, override, how, chunk_bytes, threads)
        else:
            left = content.known_content(decided.filter("eligible"), winners)
            work = _copy_work(content.leading(left, 2**turn), dest)
            spread = spread_by_bytes(work, "content_hash", files, total * 2**turn)
            ordered = spread.sortWithinPartitions("content_hash", paths.order_key(F.col("path_bytes")))
            tried = copy_in_turn(ordered, override, how, chunk_bytes)
        tried = stage(tried, f"copied-{turn}", folder)
        broken = tried.filter(F.col("copy_error").isNotNull())
        if broken.isEmpty():
            settled.append(decided)
            break
        # Contents with a failed copy are decided again, without the files that
        # failed; all others are settled.
        reasons = tried.select("path_hash", "copy_error", F.lit(True).alias("_tried"))
        retry = (
            content.known_content(decided, broken)
            .join(reasons, "path_hash", "left")
            .withColumn("eligible", F.col("eligible") & F.col("copy_error").isNull())
            .withColumn("done", F.col("done") | (F.col("_tried").isNotNull() & F.col("copy_error").isNull()))
            .withColumn("error", F.coalesce("error", "copy_error"))
            .drop("outcome", "copy_error", "_tried")
        )
        no_hash = decided.filter(F.col("content_hash").isNull())
        settled.append(content.unseen_content(decided, broken).unionByName(no_hash))
        turn += 1
        open_rows = stage(retry, f"retry-{turn}", folder)
    result = settled[0]
    for part in settled[1:]:
        result = result.unionByName(part)
    return result.drop("done")


def _copy_work(rows: DataFrame, dest: Column) -> DataFrame:
    return rows.select("path_hash", "path_bytes", dest.alias("dest_bytes"), "content_hash")


def _results(decided: DataFrame, root: bytes, dest: Column) -> DataFrame:
    return decided.select(
        paths.display(F.col("path_bytes")).alias("path"), "path_bytes", "path_hash",
        paths.display(paths.relative_bytes(F.col("path_bytes"), root)).alias("rel_path"),
        "size", "mtime_ns", "ctime_ns", "content_hash", "cache_result", "outcome",
        paths.display(dest).alias("dest_path"),
        F.when(F.col("outcome") == FAILED, F.col("error")).alias("error"),
    )


def mark_present(others: DataFrame, rows: int, threads: int) -> DataFrame:
    """Append ``present`` by asking the file system about every path.

    A check that fails leaves NULL, which keeps the entry.
    """
    spread = spread_by_bytes(others, "path_hash", rows, 0)
    return probe(spread, "path_bytes", threads).drop("probe_error")


def refresh_cache(state: State, hashed: DataFrame, use_cache: bool, cleanup: bool, threads: int) -> dict[str, int]:
    """Write the entries that changed and the paths that vanished; return the cleanup counts.

    One anti join separates the entries of this run, which exist, from all
    others, of this source or any other; only those are looked up on disk.
    """
    if not cleanup:
        state.change_cache(cache_ops.cache_entries(hashed))
        return {"checked": 0, "removed": 0}
    listed = hashed.filter(F.col("content_hash").isNotNull())
    others = cache_ops.delete(state.cache(), listed)
    if use_cache:
        kept = listed.select(*CACHE.fieldNames(), (F.col("cache_result") != UNCHANGED).alias("changed"))
    else:
        kept = state.cache().join(listed.select("path_hash"), "path_hash", "left_semi").withColumn("changed", F.lit(False))
    watch = Observation()
    probed = mark_present(others, state.cache().count(), threads).withColumn("changed", F.lit(False))
    marked = probed.select(*CACHE.fieldNames(), "present", "changed").union(kept.withColumn("present", F.lit(True)).select(*CACHE.fieldNames(), "present", "changed"))
    marked = marked.observe(watch, *cache_ops.cleanup_metrics())
    # A failed check (NULL) keeps the entry.
    gone = ~F.coalesce("present", F.lit(True))
    state.add_layer(marked.filter(gone | F.col("changed")).select(*CACHE.fieldNames(), gone.alias("gone")))
    return watch.get


def ingest_files(
    spark: SparkSession,
    source: str,
    dest_template: str | None,
    state_dir: str,
    *,
    mode: str = "copy",
    cleanup: bool = True,
    use_cache: bool = True,
    globs: Sequence[str] = (),
    override: bool = False,
    ignore_hidden: bool = False,
    copy_mode: str = "reflink",
    chunk_bytes: int = CHUNK_BYTES,
    threads: int = THREADS,
    local_tz: str | None = None,
    resume: bool = False,
) -> FileRun:
    """Copy new content from ``source`` to the rendered destination, once ever.

    ``mode="load"`` records all content as seen and copies nothing; a
    destination is then ignored. The cache is written as soon as the files are
    digested, then files are placed, the ledger comes last. A run that crashed
    before it placed anything is taken over by the next one; after a later crash
    ``resume=True`` redoes the unfinished run.
    """
    check_mode(mode, dest_template)
    listing = scan_tree(spark, source, globs, ignore_hidden)
    run = ingest_manifest(
        listing.files, source, dest_template, state_dir, mode=mode, cleanup=cleanup, use_cache=use_cache,
        override=override, copy_mode=copy_mode, chunk_bytes=chunk_bytes, threads=threads, local_tz=local_tz, resume=resume,
    )
    run.listing = listing
    return run


def ingest_manifest(
    files: DataFrame,
    source: str,
    dest_template: str | None,
    state_dir: str,
    *,
    mode: str,
    cleanup: bool,
    use_cache: bool = True,
    override: bool = False,
    copy_mode: str = "reflink",
    chunk_bytes: int = CHUNK_BYTES,
    threads: int = THREADS,
    local_tz: str | None = None,
    resume: bool = False,
) -> FileRun:
    """``ingest_files`` for a MANIFEST of files below ``source`` that is read once.

    ``cleanup`` asks whether each cached path the manifest lacks still exists.
    """
    check_mode(mode, dest_template)
    spark = files.sparkSession
    tz = local_tz or spark.conf.get("spark.sql.session.timeZone")
    root = os.fsencode(os.path.realpath(source))
    state = State(spark, state_dir)
    run_id = state.open_run(resume)
    folder = fresh_folder(spark, "file-run")
    manifest = files.withColumn("path_hash", digest.path_digest(F.col("path_bytes")))
    manifest = filters.with_errors(manifest).select(*CORE)
    if use_cache:
        classified = stage(classify_ops.classify(manifest, state.cache()), "classified", folder)
    else:
        classified = stage(classify_ops.classify_without_cache(manifest), "classified", folder)
    hashed = stage(hash_misses(classified, folder, chunk_bytes, threads), "hashed", folder)

    # Digests are kept before anything is placed: a crash below loses none of them.
    removal = {"checked": 0, "removed": 0}
    if use_cache or cleanup:
        removal = refresh_cache(state, hashed, use_cache, cleanup, threads)
    state.mark_placing(run_id)
    known = state.ledger()
    if mode == "load":
        dest = F.lit(None).cast("binary")
        decided = load_outcome(hashed)
        additions = ledger.new_entries(hashed, ledger.relevant(known, hashed), now_ms())
    else:
        prefix = os.path.join(os.getcwd(), dest_template)
        rel = paths.relative_bytes(F.col("path_bytes"), root)
        dest = template.destination_bytes(prefix, F.col("mtime_ns"), rel, tz)
        marked = stage(content.mark_known(hashed, ledger.relevant(known, hashed)), "marked", folder)
        unseen = marked.filter(~F.col("known"))
        checked = stage(check_destinations(unseen, dest, override, resume, threads), "checked", folder)
        decided = copy_winners(checked, dest, folder, override, copy_mode, chunk_bytes, threads)
        additions = ledger.entries(decided.filter(F.col("outcome") == COPIED), now_ms())
        # Known content is skipped without going through the decision.
        skipped = marked.filter("known").withColumn("eligible", F.lit(False))
        decided = decided.unionByName(skipped.withColumn("outcome", F.lit(SKIPPED)))

    state.append_ledger(additions, run_id=run_id)
    state.close_run(run_id)
    if cleanup:
        state.tend_ledger(runs=COMPACT_RUNS)
    # The frames returned below read these tables only.
    kept = ("hashed",) if mode == "load" else ("marked", "decided-", "copied-")
    for name in Folder(spark, folder).subfolders(""):
        if not name.startswith(kept):
            discard(spark, f"{folder}/{name}")
    results = _results(decided, root, dest)
    return FileRun(results, stats.ingest_stats(decided), removal["checked"], removal["removed"])
