"""Operators on the ledger of accepted contents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstseen.operators.content import distinct_contents


def entries(accepted: DataFrame, now_ms: int) -> DataFrame:
    """Ledger rows for accepted contents, one per digest."""
    return distinct_contents(accepted).withColumn("copied_time", F.lit(now_ms).cast("bigint"))


def new_entries(rows: DataFrame, ledger: DataFrame, now_ms: int) -> DataFrame:
    """Load mode: digests of ``rows`` the ledger does not hold yet.

    Rows shrink to distinct digests before they meet the ledger.
    """
    return entries(rows, now_ms).join(ledger.select("content_hash"), "content_hash", "left_anti")


def forget(ledger: DataFrame, hashes: DataFrame) -> DataFrame:
    """Ledger without the given digests; their content can be accepted again."""
    return ledger.join(hashes.select("content_hash"), "content_hash", "left_anti")


# Values of one IN that Spark hands to the Parquet reader one by one; more become a range.
_LISTED = 10
# Digests that a plan names; a larger batch is joined.
LOOKUPS = 1_000


def lookup(ledger: DataFrame, digests: Iterable[bytes]) -> DataFrame:
    """Ledger rows of at most LOOKUPS ``digests``; of a stored ledger only their pages are read.

    The digests are part of the plan, as a balanced tree of short lists of neighbours.
    """
    names = sorted({bytes(digest) for digest in digests})
    if len(names) > LOOKUPS:
        raise ValueError(f"{len(names)} digests are too many to name; join them to the ledger")

    def either(lists: list[list[bytes]]) -> Column:
        if len(lists) == 1:
            return F.col("content_hash").isin(*map(bytearray, lists[0]))
        half = len(lists) // 2
        return either(lists[:half]) | either(lists[half:])

    lists = [names[i : i + _LISTED] for i in range(0, len(names), _LISTED)]
    return ledger.filter(either(lists) if lists else F.lit(False))


def relevant(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """The part of the ledger that can concern ``rows``, a staged batch.

    Spark knows the number of its rows from the files. The digests of a small batch are looked up
    by the page index. The digests of a larger one are joined: Spark broadcasts them if they
    are few enough, and then a ledger of any size is not shuffled.
    """
    hashes = rows.filter(F.col("content_hash").isNotNull()).select("content_hash").distinct()
    if rows.count() <= LOOKUPS:
        return lookup(ledger, (row["content_hash"] for row in hashes.collect()))
    return ledger.join(hashes, "content_hash", "left_semi")


def folded(ledger: DataFrame) -> DataFrame:
    """One row per digest with the earliest acceptance time."""
    return ledger.groupBy("content_hash").agg(F.min("copied_time").alias("copied_time"))
