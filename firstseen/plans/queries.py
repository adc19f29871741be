"""One query per operator, over the given tables (see ``binding``)."""

from __future__ import annotations

import os
import shutil
import time
from collections.abc import Callable
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firstseen.functions import digest, paths, template
from firstseen.operators import cache as cache_ops
from firstseen.operators import classify, content, filters, ledger, order, stats
from firstseen.plans import binding, tables
from firstseen.plans.files import ingest_files
from firstseen.sources.content import hash_files
from firstseen.sources.tree import scan_tree
from firstseen.sources.watch import watch_tree
from firstseen.state.store import State
from firstseen.streaming.dedup import ROCKSDB, STATE_STORE, first_seen
from firstseen.streaming.ingest import ingest_stream
from firstseen.streaming.tree import ingest_tree
from firstseen.workspace import fresh_folder, mounted, setting, stage

LOCAL_TZ = "America/New_York"
# How long the files of a growing tree rest before a batch takes them.
_SETTLE_MS = 200
# Payload bytes that one task gets, and those of a batch of rows its Python holds.
_TASK_BYTES, _BATCH_BYTES = 64 << 20, 4 << 20
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
# Micro-batches of a document stream.
_BATCHES = 3


def _hex(df: DataFrame, *columns: str) -> DataFrame:
    """Report form: digests as lower-case hex."""
    return df.withColumns({c: digest.as_hex(F.col(c)) for c in columns})


def _digested(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """Documents with their digests, written once: several operators read it."""
    return stage(binding.document_files(spark, sf_dir, with_digest=True), label)


# ------------------------------------------------------------------ sources


def _write_tree_task(root: str):
    def run(batches):
        for batch in batches:
            columns = (batch.column(name) for name in ("rel_path", "payload", "mtime_ns"))
            for rel_path, payload, mtime_ns in zip(*columns):  # no second copy of the payloads
                target = f"{root}/{rel_path.as_py()}"
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "wb") as out:
                    out.write(payload.as_buffer())
                os.utime(target, ns=(mtime_ns.as_py(), mtime_ns.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    return run


def document_tree(spark: SparkSession, sf_dir: str) -> str:
    """Write every document as a file below a fresh shared folder."""
    root = mounted(fresh_folder(spark, "tree"))
    _write_documents(spark, binding.documents(spark, sf_dir), root)
    return root


def _write_documents(spark: SparkSession, source: tables.TableSource, root: str) -> None:
    rows = source.table.select(
        paths.relative_path(source.path, source.root).alias("rel_path"),
        source.payload.cast("binary").alias("payload"),
        source.mtime_ns.alias("mtime_ns"),
    )
    tasks = max(spark.sparkContext.defaultParallelism, _tasks_for(rows, "payload"))
    with setting(spark, _ARROW_BYTES, _BATCH_BYTES):
        spread = rows.repartition(tasks, "rel_path")
        spread.mapInArrow(_write_tree_task(root), "files bigint").agg(F.sum("files")).first()


def _tasks_for(rows: DataFrame, payload: str) -> int:
    """How many tasks share the payloads, each with about _TASK_BYTES of them."""
    total = rows.agg(F.sum(F.octet_length(payload))).first()[0] or 0
    return max(-(-total // _TASK_BYTES), 1)


def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = scan_tree(spark, document_tree(spark, sf_dir))
    return listing.files.select("rel_path", "size", "mtime_ns")


def scan_globbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan with an exclude glob and the hidden rule pruning directories."""
    listing = scan_tree(spark, document_tree(spark, sf_dir), ["*.txt", "!src1*/"], ignore_hidden=True)
    return listing.files.select("rel_path", "size", "mtime_ns")


def scan_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = document_tree(spark, sf_dir)
    listing = scan_tree(spark, root)
    return listing.directories.agg(F.count("*").alias("n_directories"), F.count("error").alias("n_errors"))


def ordered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.sibling_positions(binding.document_files(spark, sf_dir)).select("path", "position")


def cached_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = State(spark, fresh_folder(spark, "state"))
    state.write_cache(binding.earlier_cache(spark, sf_dir))
    return cache_ops.cached_paths(state.cache()).select(paths.display(F.col("path_bytes")).alias("path"))


# ------------------------------------------------------------------ filters


def _selected(globs: list[str], ignore_hidden: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filters.select_files(binding.document_files(spark, sf_dir), globs, ignore_hidden).select("path", "size")

    return run


def absolute_path_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secure pages keyed by their absolute URL path, the others by the whole
    URL, which is not an absolute path."""
    pages = binding.read(spark, sf_dir, "pages")
    path = F.regexp_replace("url", "^https://[^/]*", "")
    rows = pages.select(
        "page_id",
        F.when(F.col("url").startswith("https"), path).otherwise(F.col("url")).alias("path"),
        F.lit(0).cast("bigint").alias("ctime_ns"),
        F.lit(binding.T0).cast("bigint").alias("mtime_ns"),
    )
    return filters.with_errors(rows).select("page_id", "path", "error")


# -------------------------------------------------------------- projections


def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = filters.with_errors(binding.document_files(spark, sf_dir))
    return files.select("path", "size", "mtime_ns", "ctime_ns", "error")


def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = binding.read(spark, sf_dir, "documents")
    return docs.select("doc_id", digest.as_hex(digest.content_digest(F.col("text"))).alias("content_hash"))


def page_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(binding.pages(spark, sf_dir), "content_hash", "path_hash").select("path_hash", "content_hash", "size")


def path_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(binding.document_files(spark, sf_dir), "path_hash").select("path", "path_hash")


def relative_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Below the root, and NULL for a root the files do not lie in."""
    files = binding.document_files(spark, sf_dir)
    return files.select(
        "path",
        paths.relative_path(F.col("path"), binding.ROOT).alias("rel_path"),
        paths.relative_path(F.col("path"), f"{binding.ROOT}/src1").alias("rel_src1"),
    )


# -------------------------------------------------------------------- joins


def classify_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.classified(spark, sf_dir).select("path", "size", "cache_result")


def no_cache_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = binding.document_files(spark, sf_dir)
    return classify.classify_without_cache(files).select("path", "size", "cache_result")


def incremental_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a stored size the rows are classified without reading any text."""
    sized = replace(binding.documents(spark, sf_dir), size=F.col("n_chars"))
    cache = stage(binding.earlier_cache(spark, sf_dir, F.col("n_chars")), "cache")
    hashed = tables.hash_rows(sized, cache)
    path = paths.display(F.col("path_bytes")).alias("path")
    return _hex(hashed, "content_hash").select(path, "cache_result", "content_hash")


def unseen_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _digested(spark, sf_dir, "unseen")
    return _hex(content.unseen_content(files, binding.earlier_ledger(spark, sf_dir)), "content_hash").select(
        "path", "content_hash"
    )


def known_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _digested(spark, sf_dir, "known")
    return _hex(content.known_content(files, binding.earlier_ledger(spark, sf_dir)), "content_hash").select(
        "path", "content_hash"
    )


def known_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot contents: is each event's ``props`` known from the purchases?"""
    files = stage(binding.events(spark, sf_dir), "events")
    accepted = files.filter(F.startswith("path", F.lit(f"{binding.ROOT}/purchase/")))
    marked = content.mark_known(files, ledger.entries(accepted, binding.EARLIER_MS))
    return marked.select("path", "known")


def seen_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _digested(spark, sf_dir, "lookup")
    return content.seen_lookup(files, binding.earlier_ledger(spark, sf_dir)).select("path", "copied_time")


def dest_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = binding.document_files(spark, sf_dir)
    dest = template.destination(binding.TEMPLATE, F.col("mtime_ns"), F.col("rel_path"), "UTC")
    rows = files.withColumn("dest_path", dest)
    return content.destination_conflicts(rows, binding.occupied(spark, sf_dir)).select("dest_path", "dest_exists")


# ----------------------------------------------------------------- decision


def _decided(spark: SparkSession, sf_dir: str, override: bool) -> DataFrame:
    hashed = tables.hash_rows(binding.documents(spark, sf_dir), binding.earlier_cache(spark, sf_dir))
    occupied = binding.occupied(spark, sf_dir)
    placed = stage(tables.place(hashed, binding.ROOT, binding.TEMPLATE, "UTC", occupied, override), "placed")
    return content.decide(placed, binding.earlier_ledger(spark, sf_dir))


def _described(spark: SparkSession, sf_dir: str, override: bool = False) -> DataFrame:
    return tables.describe(_decided(spark, sf_dir, override), binding.ROOT, binding.TEMPLATE, "UTC")


def ingest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(spark, sf_dir).select("path", "dest_path", "outcome")


def ingest_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(spark, sf_dir, override=True).select("path", "dest_path", "outcome")


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.failures(_described(spark, sf_dir))


def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = binding.document_files(spark, sf_dir, with_digest=True)
    return _hex(content.dedup_exact(files, "size"), "content_hash")


def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every content is hot: rows shrink to their contents before the shuffle."""
    return _hex(content.dedup_exact(binding.events(spark, sf_dir)), "content_hash")


def decide_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on hot contents; click events cannot be placed."""
    files = stage(binding.events(spark, sf_dir), "events")
    blocked = F.startswith("path", F.lit(f"{binding.ROOT}/click/"))
    rows = files.withColumn("eligible", ~blocked).withColumn("known", F.lit(False))
    return content.decide(rows).select("path", "outcome")


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = binding.document_files(spark, sf_dir, with_digest=True)
    return _hex(content.duplicate_groups(files), "content_hash")


def duplicate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(content.duplicate_groups(binding.events(spark, sf_dir)), "content_hash")


# ------------------------------------------------------------- aggregations


def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ingest_stats(_decided(spark, sf_dir, override=False))


def cached_path_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = State(spark, fresh_folder(spark, "state"))
    state.write_cache(binding.earlier_cache(spark, sf_dir))
    return cache_ops.cached_path_count(state.cache())


def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.scan_counts(binding.document_files(spark, sf_dir))


# -------------------------------------------------------- state maintenance


def _cache_report(cache: DataFrame) -> DataFrame:
    return _hex(cache, "content_hash").select(
        paths.display(F.col("path_bytes")).alias("path"), "size", "mtime_ns", "ctime_ns", "content_hash"
    )


def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = State(spark, fresh_folder(spark, "state"))
    state.write_cache(binding.earlier_cache(spark, sf_dir))
    hashed = stage(tables.hash_rows(binding.documents(spark, sf_dir), state.cache()), "hashed")
    state.change_cache(cache_ops.cache_entries(hashed))
    return _cache_report(state.cache())


def cache_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete the entries of the files whose destination is occupied."""
    state = State(spark, fresh_folder(spark, "state"))
    state.write_cache(binding.earlier_cache(spark, sf_dir))
    docs = binding.documents(spark, sf_dir)
    gone = docs.table.filter("lang = 'de'").select(digest.path_digest(docs.path).alias("path_hash"))
    state.change_cache(gone=gone)
    return _cache_report(state.cache())


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English files have vanished from the source."""
    docs = binding.documents(spark, sf_dir)
    present = docs.table.filter("lang <> 'en'").select(digest.path_digest(docs.path).alias("path_hash"))
    return cache_ops.mark_present(binding.earlier_cache(spark, sf_dir), present, binding.ROOT)


def cache_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache_report(cache_ops.keep_present(_marked(spark, sf_dir)))


def cleanup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache_ops.cleanup_counts(_marked(spark, sf_dir))


def _state_with_memory(spark: SparkSession, sf_dir: str) -> State:
    state = State(spark, fresh_folder(spark, "state"))
    state.append_ledger(binding.earlier_ledger(spark, sf_dir))
    return state


def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _state_with_memory(spark, sf_dir)
    files = binding.document_files(spark, sf_dir, with_digest=True)
    state.append_ledger(ledger.new_entries(files, state.ledger(), binding.NOW_MS))
    return _hex(state.ledger(), "content_hash").select("content_hash", "copied_time", "writer", "run_id")


def ledger_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forget what the English documents hold."""
    state = _state_with_memory(spark, sf_dir)
    docs = binding.read(spark, sf_dir, "documents").filter("lang = 'en'")
    state.forget(content.distinct_contents(docs.select(digest.content_digest(F.col("text")).alias("content_hash"))))
    return _hex(state.ledger(), "content_hash").select("content_hash", "copied_time")


def ledger_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs that overlap fold into one row per content, earliest time."""
    state = _state_with_memory(spark, sf_dir)
    files = binding.document_files(spark, sf_dir, with_digest=True)
    state.append_ledger(ledger.entries(files, binding.NOW_MS))
    state.compact_ledger()
    return _hex(state.ledger(), "content_hash").select("content_hash", "copied_time", "writer")


def ledger_forget_then_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forget the English contents, accept the Spanish ones again, fold all."""
    state = _state_with_memory(spark, sf_dir)
    docs = binding.document_files(spark, sf_dir, with_digest=True)
    state.forget(content.distinct_contents(docs.filter(F.contains("path", F.lit("/en/")))))
    state.append_ledger(ledger.entries(docs.filter(F.contains("path", F.lit("/es/"))), binding.NOW_MS))
    state.compact_ledger()
    return _hex(state.ledger(), "content_hash").select("content_hash", "copied_time", "writer")


def load_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    state_dir = fresh_folder(spark, "state")
    state = State(spark, state_dir)
    tables.ingest_table(binding.documents(spark, sf_dir), state_dir, mode="load", cleanup=False)
    return _hex(state.ledger(), "content_hash").select("content_hash", "writer", "run_id")


# ----------------------------------------------------------------- template


def render_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates through a template that repeats a token and keeps unknown ones."""
    orders = binding.read(spark, sf_dir, "orders")
    ns = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)") * 1000
    rendered = template.render("out/{year_utc}/{year_utc}-{month_utc}-{day_utc}/{YEAR_UTC}", ns, "UTC")
    return orders.select("o_orderkey", rendered.alias("rendered"))


def render_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = binding.document_files(spark, sf_dir)
    rendered = template.render("out/{year_local}/{month_local}/{day_local}", F.col("mtime_ns"), LOCAL_TZ)
    return files.select("path", rendered.alias("rendered"))


def destination_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = binding.document_files(spark, sf_dir)
    dest = template.destination(binding.TEMPLATE, F.col("mtime_ns"), F.col("rel_path"), "UTC")
    return files.select("path", dest.alias("dest_path"))


# -------------------------------------------------------------------- sinks


def accepted_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole table run into the dated sink, on top of earlier memory."""
    state_dir, sink = fresh_folder(spark, "state"), fresh_folder(spark, "sink")
    State(spark, state_dir).append_ledger(binding.earlier_ledger(spark, sf_dir), writer="earlier")
    tables.ingest_table(
        binding.documents(spark, sf_dir), state_dir, binding.TEMPLATE,
        existing=binding.occupied(spark, sf_dir), local_tz="UTC", sink=sink,
    )
    written = spark.read.parquet(f"{sink}/run_id=0")
    return written.select(
        "doc_id", "text", *[F.col(f"{c}_utc").cast("bigint").alias(c) for c in ("year", "month", "day")]
    )


def accepted_by_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink laid out by local year and month, of a table with a ``year`` of its own."""
    state_dir, sink = fresh_folder(spark, "state"), fresh_folder(spark, "sink")
    source = binding.documents(spark, sf_dir)
    source = replace(source, table=source.table.withColumn("year", F.lit(1815) + F.col("doc_id") % 100))
    tables.ingest_table(
        source, state_dir, "/dest/{year_local}-{month_local}", local_tz=LOCAL_TZ, sink=sink,
    )
    return spark.read.parquet(f"{sink}/run_id=0").withColumns(
        {c: F.col(c).cast("bigint") for c in ("year", "year_local", "month_local")}
    )


def copy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole file run on the document tree, read back from the destination."""
    tree, dest = document_tree(spark, sf_dir), mounted(fresh_folder(spark, "dest"))
    ingest_files(
        spark, tree, dest + "/{year_utc}/{month_utc}/{day_utc}", fresh_folder(spark, "state"), local_tz="UTC"
    )
    return _placed(spark, dest)


def _placed(spark: SparkSession, dest: str) -> DataFrame:
    """What lies below a destination: names, sizes, and digests of the bytes."""
    files = scan_tree(spark, dest).files
    return _hex(hash_files(files), "content_hash").select("rel_path", "size", "content_hash")


def override_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document has the same destination folder, where all names are taken
    by empty files: the run replaces those of the files that win."""
    tree, dest = document_tree(spark, sf_dir), mounted(fresh_folder(spark, "dest"))
    names = scan_tree(spark, tree).files.select("rel_path", F.lit(b"").alias("payload"), F.lit(0).alias("mtime_ns"))
    names.mapInArrow(_write_tree_task(f"{dest}/all"), "files bigint").agg(F.sum("files")).first()
    ingest_files(spark, tree, f"{dest}/all", fresh_folder(spark, "state"), override=True)
    return _placed(spark, dest)


def cleanup_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after a run over a tree from which every file of one source has gone."""
    tree, state_dir = document_tree(spark, sf_dir), fresh_folder(spark, "state")
    ingest_files(spark, tree, None, state_dir, mode="load")
    shutil.rmtree(f"{tree}/src1")
    run = ingest_files(spark, tree, None, state_dir, mode="load", globs=["!*.txt"])
    left = State(spark, state_dir).cache()
    rel = paths.display(paths.relative_bytes(F.col("path_bytes"), tree.encode()))
    return _hex(left, "content_hash").select(
        rel.alias("rel_path"), "size", "content_hash", F.lit(run.removed).cast("bigint").alias("removed")
    )


def load_then_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The English documents are preloaded; a copy run over all skips their contents."""
    state_dir = fresh_folder(spark, "state")
    source = binding.documents(spark, sf_dir)
    english = replace(source, table=source.table.filter("lang = 'en'"))
    tables.ingest_table(english, state_dir, mode="load")
    run = tables.ingest_table(source, state_dir, binding.TEMPLATE, local_tz="UTC", sink=fresh_folder(spark, "sink"))
    return run.results.select("path", "cache_result", "outcome")


def resume_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run after one that was lost between hashing and placing."""
    state_dir = fresh_folder(spark, "state")
    lost = State(spark, state_dir)
    lost.open_run()
    lost.write_cache(binding.earlier_cache(spark, sf_dir))
    source = binding.documents(spark, sf_dir)
    return tables.ingest_table(
        source, state_dir, binding.TEMPLATE, local_tz="UTC", sink=fresh_folder(spark, "sink")
    ).stats


def failures_globbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only secure pages lie below the root; the others fail whatever the glob says."""
    pages = binding.read(spark, sf_dir, "pages")
    key = F.concat_ws("/", "page_id", "url")
    path = F.when(F.col("url").startswith("https"), F.concat(F.lit(f"{binding.ROOT}/"), key)).otherwise(key)
    source = tables.TableSource(pages, path, F.col("html"), F.lit(binding.T0).cast("bigint"), binding.ROOT)
    run = tables.ingest_table(
        source, fresh_folder(spark, "state"), "/dest", globs=["!/1*/"], sink=fresh_folder(spark, "sink")
    )
    return run.results.select("path", "outcome", "error")


def failures_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document was written before 1970, every fifth at an unknown time."""
    docs = binding.documents(spark, sf_dir)
    number = F.col("doc_id")
    mtime_ns = F.when(number % 5 != 0, F.when(number % 3 == 0, -docs.mtime_ns).otherwise(docs.mtime_ns))
    source = replace(docs, mtime_ns=mtime_ns)
    run = tables.ingest_table(source, fresh_folder(spark, "state"), mode="load")
    return stats.failures(run.results)


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a second table run: all is unchanged and known by then."""
    state_dir = fresh_folder(spark, "state")
    source = binding.documents(spark, sf_dir)
    tables.ingest_table(source, state_dir, binding.TEMPLATE, local_tz="UTC", caller_stores=True)
    return tables.ingest_table(source, state_dir, binding.TEMPLATE, local_tz="UTC", caller_stores=True).stats


# ---------------------------------------------------------------- streaming


def _document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a file stream of several micro-batches, each of files of bounded size."""
    folder = fresh_folder(spark, "incoming")
    docs = binding.read(spark, sf_dir, "documents")
    files = -(-_tasks_for(docs, "text") // _BATCHES)
    docs.repartition(_BATCHES * files, "doc_id").write.parquet(folder)
    return spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _streamed(spark: SparkSession, sf_dir: str) -> tuple[State, str]:
    """Three micro-batches on top of earlier memory; the state and the sink afterwards."""
    state_dir, sink = fresh_folder(spark, "state"), fresh_folder(spark, "sink")
    state = State(spark, state_dir)
    state.append_ledger(binding.earlier_ledger(spark, sf_dir), writer="earlier")
    shape = binding.documents(spark, sf_dir)
    query = ingest_stream(
        _document_stream(spark, sf_dir),
        lambda batch: tables.TableSource(batch, shape.path, shape.payload, shape.mtime_ns, shape.root),
        state_dir, "documents", fresh_folder(spark, "checkpoint"), sink, binding.TEMPLATE, local_tz="UTC",
    )
    query.awaitTermination()
    return state, sink


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after a stream."""
    state, _ = _streamed(spark, sf_dir)
    return _hex(state.ledger(), "content_hash").select("content_hash", "writer")


def stream_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts a stream accepted. Which of equal texts comes first depends on the
    batches, so the rows are reported without their ids."""
    _, sink = _streamed(spark, sf_dir)
    return spark.read.parquet(sink).select("text", F.col("writer").alias("accepted_by"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rows per content over three micro-batches, from a Parquet sink."""
    out = fresh_folder(spark, "first-seen")
    hashes = _document_stream(spark, sf_dir).select(digest.content_digest(F.col("text")).alias("content_hash"))
    with setting(spark, STATE_STORE, ROCKSDB):
        query = (
            first_seen(hashes).writeStream.format("parquet")
            .option("checkpointLocation", fresh_folder(spark, "checkpoint"))
            .trigger(availableNow=True).start(out)
        )
    query.awaitTermination()
    return _hex(spark.read.schema("content_hash binary").parquet(out), "content_hash")


def _grow_tree(spark: SparkSession, sf_dir: str, on_growth: Callable[[str], None]) -> None:
    """Write the documents as files in three parts, and call ``on_growth`` after each."""
    root = mounted(fresh_folder(spark, "tree"))
    os.makedirs(root)
    docs = binding.documents(spark, sf_dir)
    for part in range(3):
        _write_documents(spark, replace(docs, table=docs.table.filter(F.crc32(docs.path) % 3 == part)), root)
        time.sleep(2 * _SETTLE_MS / 1_000)
        on_growth(root)


def stream_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a watched tree delivers over three batches, from a Parquet sink."""
    out, checkpoint = fresh_folder(spark, "delivered"), fresh_folder(spark, "checkpoint")

    def deliver(root: str) -> None:
        files = watch_tree(spark, root, once=True, settle_ms=_SETTLE_MS).select("rel_path", "size", "mtime_ns")
        query = files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        query.awaitTermination()

    with setting(spark, STATE_STORE, ROCKSDB):
        _grow_tree(spark, sf_dir, deliver)
    return spark.read.schema("rel_path string, size bigint, mtime_ns bigint").parquet(out)


def stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files a continuous ingest of a growing tree placed. Which of equal files
    comes first depends on the batches, so they are reported without their names."""
    dest, state_dir = mounted(fresh_folder(spark, "dest")), fresh_folder(spark, "state")
    os.makedirs(dest)
    checkpoint = fresh_folder(spark, "checkpoint")
    _grow_tree(spark, sf_dir, lambda root: ingest_tree(
        spark, root, dest, state_dir, checkpoint, settle_ms=_SETTLE_MS).awaitTermination())
    return _placed(spark, dest).select("size", "content_hash")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "manifest_scan": manifest_scan,
    "scan_globbed": scan_globbed,
    "scan_directories": scan_directories,
    "ordered_scan": ordered_scan,
    "cached_paths": cached_paths,
    "glob_include": _selected(["*.txt"]),
    "glob_exclude": _selected(["!*.txt", "!/src1?/"]),
    "glob_list": _selected(["src*/{en,fr}/**", "!**/[0-4]*"]),
    "ignore_hidden": _selected([], ignore_hidden=True),
    "absolute_path_check": absolute_path_check,
    "file_metadata": file_metadata,
    "content_digest": content_digest,
    "page_digest": page_digest,
    "path_digest": path_digest,
    "relative_path": relative_path,
    "classify_changes": classify_changes,
    "no_cache_classify": no_cache_classify,
    "incremental_hash": incremental_hash,
    "unseen_content": unseen_content,
    "known_content": known_content,
    "known_events": known_events,
    "seen_lookup": seen_lookup,
    "dest_conflicts": dest_conflicts,
    "ingest_decision": ingest_decision,
    "ingest_override": ingest_override,
    "failures": failures,
    "failures_metadata": failures_metadata,
    "failures_globbed": failures_globbed,
    "dedup_exact": dedup_exact,
    "dedup_events": dedup_events,
    "decide_events": decide_events,
    "duplicate_groups": duplicate_groups,
    "duplicate_events": duplicate_events,
    "ingest_stats": ingest_stats,
    "run_stats": run_stats,
    "resume_stats": resume_stats,
    "cached_path_count": cached_path_count,
    "scan_counts": scan_counts,
    "cache_upsert": cache_upsert,
    "cache_delete": cache_delete,
    "cache_cleanup": cache_cleanup,
    "cleanup_counts": cleanup_counts,
    "ledger_append": ledger_append,
    "ledger_forget": ledger_forget,
    "ledger_compact": ledger_compact,
    "ledger_forget_then_compact": ledger_forget_then_compact,
    "load_seen": load_seen,
    "load_then_ingest": load_then_ingest,
    "render_utc": render_utc,
    "render_local": render_local,
    "destination_path": destination_path,
    "accepted_by_day": accepted_by_day,
    "accepted_by_template": accepted_by_template,
    "copy_files": copy_files,
    "cleanup_files": cleanup_files,
    "override_files": override_files,
    "stream_ingest": stream_ingest,
    "stream_accepted": stream_accepted,
    "stream_dedup": stream_dedup,
    "stream_tree": stream_tree,
    "stream_files": stream_files,
}
