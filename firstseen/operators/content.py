"""Joins and groups on the content digest, the one key that can be hot.

All empty files share a digest, and one boilerplate payload may make up a third
of a source. So rows are never brought together by digest as they are. Facts per
content come from an aggregation that combines on the map side. The rows then
meet the facts of hot contents by broadcast, and only rows of other contents by
a shuffle on the digest. A content is hot if it has more than one in
``HOT_PARTS`` of all rows, so fewer than ``HOT_PARTS`` contents can be hot, and
no shuffled group is larger than that share, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firstseen.functions import paths
from firstseen.schemas import COPIED, FAILED, SKIPPED

HOT_PARTS = 10_000
SALTS = 1024


def distinct_contents(rows: DataFrame) -> DataFrame:
    """One row per digest; partial aggregation runs before the shuffle.

    Rows without a digest are dropped by a count after the aggregation. A null
    test would be pushed below it and digest every payload a second time.
    """
    counted = rows.groupBy("content_hash").agg(F.count("content_hash").alias("_n"))
    return counted.filter("_n > 0").select("content_hash")


def _per_content(rows: DataFrame, *facts: Column) -> DataFrame:
    """Facts and the row count ``_n`` of every content."""
    return rows.filter(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.count("*").alias("_n"), *facts)


def _with_facts(rows: DataFrame, facts: DataFrame, hot_parts: int) -> DataFrame:
    """Left-join facts per content to all rows; ``rows`` is staged.

    Its row count, read from file footers, sets the bound above which a content
    is hot. Rows of hot contents and rows without a digest take their path as
    the shuffle key, which no digest equals, so they spread evenly; without a path
    a hash of the whole row.
    """
    above = max(rows.count() // hot_parts, 1)
    names = [c for c in facts.columns if c not in ("content_hash", "_n")]
    hot = facts.filter(F.col("_n") > above).select("content_hash", F.struct(*names).alias("_hot"))
    cold = facts.filter(F.col("_n") <= above).select(F.col("content_hash").alias("_key"), F.struct(*names).alias("_cold"))
    spread = F.col("_hot").isNotNull() | F.col("content_hash").isNull()
    own = F.coalesce(F.col("path_bytes"), F.unhex(F.hex(F.xxhash64(*rows.columns))))
    joined = (
        rows.withColumn("_own", own)
        .join(F.broadcast(hot), "content_hash", "left")
        .withColumn("_key", F.when(spread, F.col("_own")).otherwise(F.col("content_hash")))
        .join(cold, "_key", "left")
    )
    found = {name: F.coalesce(F.col(f"_hot.{name}"), F.col(f"_cold.{name}")) for name in names}
    return joined.withColumns(found).drop("_key", "_own", "_hot", "_cold")


def _with_hit(rows: DataFrame, ledger: DataFrame, hot_parts: int) -> DataFrame:
    hits = _per_content(rows).join(ledger.select("content_hash"), "content_hash", "left_semi")
    return _with_facts(rows, hits.withColumn("_hit", F.lit(True)), hot_parts)


def mark_known(rows: DataFrame, ledger: DataFrame, hot_parts: int = HOT_PARTS) -> DataFrame:
    """Append ``known``; rows without a digest are not known."""
    marked = _with_hit(rows, ledger, hot_parts)
    return marked.withColumn("known", F.coalesce("_hit", F.lit(False))).drop("_hit")


def unseen_content(rows: DataFrame, ledger: DataFrame, hot_parts: int = HOT_PARTS) -> DataFrame:
    """Rows whose content the ledger does not hold; rows without a digest are none."""
    marked = _with_hit(rows, ledger, hot_parts)
    return marked.filter(F.col("_hit").isNull() & F.col("content_hash").isNotNull()).drop("_hit")


def known_content(rows: DataFrame, ledger: DataFrame, hot_parts: int = HOT_PARTS) -> DataFrame:
    """Rows whose content the ledger holds."""
    return _with_hit(rows, ledger, hot_parts).filter(F.col("_hit").isNotNull()).drop("_hit")


def seen_lookup(rows: DataFrame, ledger: DataFrame, hot_parts: int = HOT_PARTS) -> DataFrame:
    """Rows the ledger knows, with the time their content was first accepted."""
    first = ledger.groupBy("content_hash").agg(F.min("copied_time").alias("copied_time"))
    found = _with_facts(rows, _per_content(rows).join(first, "content_hash"), hot_parts)
    return found.filter(F.col("copied_time").isNotNull())


def destination_conflicts(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Append ``dest_exists`` from a listing of the destination.

    Destination paths are unique on both sides, so this join cannot skew. A row
    without a destination joins by its own path behind a NUL, which no listed
    path contains, because NULL keys would all meet in one task.
    """
    taken = existing.select(F.col("dest_path").alias("_dest"), F.lit(True).alias("_taken")).distinct()
    none = F.concat(F.lit("\x00"), F.hex("path_bytes"))
    return (
        rows.withColumn("_dest", F.coalesce(F.col("dest_path"), none))
        .join(taken, "_dest", "left")
        .withColumn("dest_exists", F.coalesce("_taken", F.lit(False)))
        .drop("_taken", "_dest")
    )


def decide(rows: DataFrame, ledger: DataFrame | None = None, hot_parts: int = HOT_PARTS) -> DataFrame:
    """Append ``outcome``: the first file that can be placed wins its content.

    ``rows`` is staged and has ``path_bytes``, ``content_hash``, ``eligible``,
    and ``known`` when no ledger is given. The result equals visiting the files
    one by one in component-wise path order, where a failed file records nothing:

    * known content is skipped, whatever else is wrong with the row;
    * the first eligible file of a content is copied;
    * files after it are skipped;
    * files before it, and all files of a content without an eligible one, fail.

    Rows without a digest fail.
    """
    key = paths.order_key(F.col("path_bytes"))
    ok = F.coalesce(F.col("eligible"), F.lit(False))
    facts = _per_content(rows, F.min(F.when(ok, key)).alias("_first"))
    if ledger is not None:
        # Contents are unique on both sides and already partitioned by digest.
        facts = facts.join(distinct_contents(ledger).withColumn("_hit", F.lit(True)), "content_hash", "left")
    known = F.col("known") if ledger is None else F.coalesce(F.col("_hit"), F.lit(False))
    first = F.col("_first")
    outcome = (
        F.when(F.col("content_hash").isNull(), F.lit(FAILED))
        .when(known, F.lit(SKIPPED))
        .when(first.isNull() | (key < first), F.lit(FAILED))
        .when(key == first, F.lit(COPIED))
        .otherwise(F.lit(SKIPPED))
    )
    return _with_facts(rows, facts, hot_parts).withColumn("outcome", outcome).drop("_first", "_hit")


def leading(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of every content in path order.

    A salt from the path splits every content into shares, which are cut to
    ``n`` rows before the content comes together.
    """
    key = paths.order_key(F.col("path_bytes"))
    salt = F.pmod(F.xxhash64("path_bytes"), F.lit(SALTS)).cast("int")
    share = Window.partitionBy("content_hash", "_salt").orderBy(key)
    whole = Window.partitionBy("content_hash").orderBy(key)
    cut = rows.withColumn("_salt", salt).withColumn("_rank", F.row_number().over(share)).filter(F.col("_rank") <= n)
    return cut.withColumn("_rank", F.row_number().over(whole)).filter(F.col("_rank") <= n).drop("_salt", "_rank")


def dedup_exact(rows: DataFrame, *carry: str) -> DataFrame:
    """One row per content: the first path, with the ``carry`` columns of it.

    Rows without a digest have no content and give no row.
    """
    first = F.min(F.struct(paths.order_key(F.col("path_bytes")).alias("_key"), *carry)).alias("_first")
    best = rows.filter(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(first)
    path = paths.display(paths.path_of_key(F.col("_first._key")))
    return best.select("content_hash", path.alias("path"), *[f"_first.{c}" for c in carry])


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """Contents that occur more than once: how often, how large, who is first."""
    return (
        rows.groupBy("content_hash")
        .agg(
            F.count("content_hash").alias("n_files"),
            F.sum("size").alias("n_bytes"),
            paths.display(paths.path_of_key(F.min(paths.order_key(F.col("path_bytes"))))).alias("first_path"),
        )
        .filter(F.col("n_files") > 1)
    )
