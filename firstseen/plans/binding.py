"""The given tables seen as source trees, with the state earlier runs left.

``documents`` becomes a tree ``/source/<source>/<lang>/<doc>``. The memory of
earlier runs is derived from the tables as well: contents labelled good were
accepted before; every language but Spanish was hashed before, and the French
files have been touched since; German destinations are occupied.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firstseen.functions import digest, template
from firstseen.operators import classify, ledger
from firstseen.plans.tables import TableSource
from firstseen.schemas import CACHE
from firstseen.workspace import stage

ROOT = "/source"
TEMPLATE = "/dest/{year_utc}/{month_utc}/{day_utc}"
# Acceptance time of everything the ledger holds before the run, and the run's.
EARLIER_MS, NOW_MS = 1_600_000_000_000, 1_700_000_000_000
# Fixed values of the binding: start of the file times, step, and span (150 days).
T0, STEP, SPAN = 1_700_000_000, 43_201, 12_960_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> TableSource:
    docs = read(spark, sf_dir, "documents")
    extension = F.when(F.col("lang") == "en", ".txt").when(F.col("lang") == "de", ".TXT").otherwise(".Log")
    hidden_dir = F.when(F.col("source") == "src7", ".").otherwise("")
    hidden_file = F.when(F.col("n_chars") % 10 == 0, ".").otherwise("")
    path = F.concat(
        F.lit(ROOT + "/"), hidden_dir, "source", F.lit("/"), "lang", F.lit("/"),
        hidden_file, F.col("doc_id").cast("string"), extension,
    )
    seconds = F.lit(T0) + (F.col("doc_id") * STEP) % F.lit(SPAN)
    mtime_ns = seconds * F.lit(1_000_000_000).cast("bigint") + F.col("n_chars")
    return TableSource(docs, path, F.col("text"), mtime_ns, ROOT)


def document_files(spark: SparkSession, sf_dir: str, with_digest: bool = False) -> DataFrame:
    return documents(spark, sf_dir).manifest(with_digest)


def earlier_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents accepted by earlier runs, a stored table: those labelled good."""
    good = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    kept = read(spark, sf_dir, "documents").join(good, "doc_id", "left_semi")
    hashes = kept.select(digest.content_digest(F.col("text")).alias("content_hash"))
    return stage(ledger.entries(hashes, EARLIER_MS), "memory")


def earlier_cache(spark: SparkSession, sf_dir: str, size: Column | None = None) -> DataFrame:
    """Cache of earlier runs; French files were hashed with an older time."""
    source = documents(spark, sf_dir)
    older = F.when(F.col("lang") == "fr", source.mtime_ns - 1).otherwise(source.mtime_ns)
    cached = replace(source, table=source.table.filter("lang <> 'es'"), mtime_ns=older, size=size)
    return cached.manifest(with_digest=True).select(*CACHE.fieldNames())


def occupied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing of the destination: the German files are already there."""
    source = documents(spark, sf_dir)
    files = replace(source, table=source.table.filter("lang = 'de'")).manifest()
    return files.select(template.destination(TEMPLATE, F.col("mtime_ns"), F.col("rel_path"), "UTC").alias("dest_path"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(document_files(spark, sf_dir), earlier_cache(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files whose content is ``props``: a few, very hot contents."""
    source = TableSource(
        read(spark, sf_dir, "events"),
        F.concat(F.lit(ROOT + "/"), "event_type", F.lit("/"), F.col("event_id").cast("string")),
        F.col("props"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") * 1000,
        ROOT,
    )
    return source.manifest(with_digest=True)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files; the path is the URL below the root."""
    source = TableSource(
        read(spark, sf_dir, "pages"),
        F.concat(F.lit(ROOT + "/"), F.col("page_id").cast("string"), F.lit("/"), F.regexp_replace("url", "^https?://", "")),
        F.col("html"),
        F.lit(T0).cast("bigint") * 1_000_000_000,
        ROOT,
    )
    return source.manifest(with_digest=True)
