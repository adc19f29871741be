"""Exact dedup by a streaming digest state, hits checked byte by byte.

Texts are equal when their bytes are. Arriving rows carry a digest, the document
id and a locator (file, row). A streaming aggregation keeps, per digest, the
largest (id, locator) and the number of rows, in RocksDB state on disk, without
expiry; it is partitioned by digest, combines before its shuffle and survives
executors, because every batch commits to the shared checkpoint folder. A digest
that has come more than once is a hit, and only hits have their full texts
compared. Should different texts share a digest, they are decided by text.

Defined results. Null text counts as empty. Null ids sort below all others. Of
rows equal in text and id, the one with the largest locator stays, so exactly
one row of a class is kept. Texts of any length are hashed and compared whole.
Only ``doc_id`` and ``text`` are read; other columns may have any name. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firstseen.llm.common import SHARE, located, spread_join, stored, with_facts
from firstseen.workspace import fresh_folder, stage

_STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A store is closed when its batch is committed: its files are in the checkpoint
    # folder, and an open one would hold preallocated space on the executor.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def arrivals_of(docs: DataFrame, digest=sha256) -> DataFrame:
    """(digest, doc_id, file, row): all that the state ever sees of a document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return located(docs, digest(text).alias("digest"), F.col("doc_id"))


def run_state(spark: SparkSession, arrivals: str, schema, checkpoint: str, files_per_batch: int = 10_000) -> DataFrame:
    """Feed every file of ``arrivals`` not yet seen by ``checkpoint`` to the state.

    Returns the state: (digest, keep, group_size). Calling it again after more
    files have come goes on from the committed batches.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals)
    seen = stream.groupBy("digest").agg(
        F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )
    before = {key: spark.conf.get(key, None) for key in _STATE_STORE}
    for key, value in _STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        query = (
            seen.writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    state = spark.read.format("statestore").load(checkpoint)
    keep, size = state.schema["value"].dataType.names
    return state.select(
        F.col("key.digest").alias("digest"), F.col(f"value.`{keep}`").alias("keep"), F.col(f"value.`{size}`").alias("group_size")
    )


def shared_digests(docs: DataFrame, state: DataFrame, total: int, digest=sha256) -> DataFrame:
    """Digests of hits that stand for more than one text, by comparing the texts.

    Equal texts are combined before they are shuffled, so a group of copies of
    any size sends one text per task. Normally empty.
    """
    hits = state.filter("group_size > 1")
    heavy = F.col("group_size") * SHARE > total
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(digest(text).alias("digest"), text.alias("text"))
    hot, cold = hits.filter(heavy).select("digest"), hits.filter(~heavy).select("digest")
    # Fewer than SHARE digests are heavy; their rows are not dealt out by digest.
    checked = rows.join(F.broadcast(hot), "digest", "left_semi").unionByName(
        rows.join(F.broadcast(hot), "digest", "left_anti").join(cold.hint("shuffle_hash"), "digest", "left_semi")
    )
    texts = checked.groupBy("digest", "text").agg(F.lit(1).alias("one"))
    return texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts")).filter("n_texts > 1").select("digest")


def decisions(docs: DataFrame, digest=sha256) -> DataFrame:
    """One row per document: file, row, digest, doc_id, keep_id, group_size, kept."""
    spark = docs.sparkSession
    docs = stored(docs)
    folder = fresh_folder(spark, "exact-dedup")
    arrivals = stage(arrivals_of(docs, digest), "arrivals", folder)
    total = arrivals.count()
    if total == 0:
        return arrivals.select("*", F.lit(None).cast(arrivals.schema["doc_id"].dataType).alias("keep_id"), F.lit(0).cast("bigint").alias("group_size"), F.lit(False).alias("kept"))
    state = stage(run_state(spark, f"{folder}/arrivals", arrivals.schema, f"{folder}/state"), "seen", folder)
    decided = spread_join(arrivals, state, "digest")
    shared = stage(shared_digests(docs, state, total, digest), "shared", folder)
    if not shared.isEmpty():
        decided = decided.join(shared, "digest", "left_anti").unionByName(_by_text(docs, shared, digest))
    return decided.select(
        "file", "row", "digest", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))).alias("kept"),
    )


def _by_text(docs: DataFrame, shared: DataFrame, digest) -> DataFrame:
    """The same decision where a digest is not enough: classes by whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = located(docs, digest(text).alias("digest"), F.col("doc_id"), text.alias("text")).join(shared, "digest", "left_semi")
    classes = rows.groupBy("digest", "text").agg(
        F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )
    return rows.join(classes, ["digest", "text"]).select("digest", "doc_id", "file", "row", "keep", "group_size")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of equal texts."""
    docs = stored(docs)
    return with_facts(docs, decisions(docs).filter("kept").select("file", "row"), "left_semi")
