"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are put in a hashed order. A document's virtual finish
time is the number of words its source has given up to and including it, divided
by the source's target, so all sources reach their targets at time 1. All
documents, sorted by that time, make the mix, cut where the budget is used up. A
target above the source's size makes a second pass over the source.

Running sums do not need a source, or everything, in one task: hashed slices of
each source are summed first, then slice totals are accumulated, and only rows
within a slice are sorted. The same goes for finish times, where just the slice
in which the budget runs out is sorted.

Defined results. Null text has size 0 and is taken 0 times, as is every text
without words. A null source is a source of its own, after all others. Order is
by md5 of id and text; rows equal in both are interchangeable. An empty table,
or one without words, gives targets of 0. Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firstseen.llm.common import located, stored, with_facts
from firstseen.workspace import stage

WEIGHTS = (5, 2, 1)
BUDGET = 1.5  # of the size of all documents
REPEATS = 2  # passes over a source at most
# Words: fixed pattern of the contract.
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def shuffle_key(doc_id: Column, text: Column) -> Column:
    spell = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.md5(F.concat(spell(doc_id), F.lit("/"), F.md5(spell(text))))


def _slices(rows: int) -> int:
    """As many slices as a slice has rows: neither level of a running sum grows faster."""
    return max(1, math.isqrt(rows))


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """(source, place, source_size, target) from (source, source_size).

    Sources are filled in order of capacity per weight: a source whose fair share
    of what is left reaches its capacity is capped, the rest share by weight. One
    row per source, so the unpartitioned windows sort a table of sources only.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") - 1) % len(weights) + 1).cast("bigint")
    ranked = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("weight", weight)
    ranked = ranked.withColumn("capacity", F.col("source_size") * repeats)
    filled = Window.orderBy((F.col("capacity") / F.col("weight")).asc(), "place")
    shared = ranked.select(
        "*",
        (F.lit(float(budget)) * F.sum("source_size").over(everything)).alias("budget"),
        F.coalesce(F.sum("capacity").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("weight").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("weights"),
    )
    capped = F.col("weight") * (F.col("budget") - F.col("before")) / F.col("weights") >= F.col("capacity")
    marked = shared.withColumn("capped", capped)
    left = marked.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("capped"), F.col("capacity"))).over(everything), F.lit(0)).alias("spent"),
        F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything).alias("sharing"),
    )
    share = F.col("weight") * (F.col("budget") - F.col("spent")) / F.col("sharing")
    target = F.when(F.col("capped"), F.col("capacity").cast("double")).otherwise(share)
    return left.select("source", "place", "source_size", target.alias("target"))


def finish_times(docs: DataFrame, **options) -> DataFrame:
    """(file, row, doc_id, key, size, place, source_size, target, first): staged.

    ``first`` is the finish time of the document's first copy; that of copy ``c``
    is ``(source_size * c + cumulative) / target``.
    """
    text = F.col("text")
    rows = stage(
        located(docs, F.col("doc_id"), F.col("source").cast("string").alias("source"), size_of(text).alias("size"), shuffle_key(F.col("doc_id"), text).alias("key")),
        "mix-rows",
    )
    slices = _slices(rows.count())
    part = (F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * slices / 2**32).cast("int")
    sums = stage(rows.groupBy("source", part.alias("slice")).agg(F.sum("size").alias("words")), "mix-slices")
    wanted = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), **options)
    # Slice totals: one row per source and slice.
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source", "slice", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "slice").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumn("slice", part).withColumn("run", F.sum("size").over(within))
    facts = base.alias("b").join(wanted.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.*", "place", "source_size", "target")
    joined = run.alias("r").join(
        facts.alias("f"), F.col("r.source").eqNullSafe(F.col("f.source")) & (F.col("r.slice") == F.col("f.slice"))
    )
    return stage(
        joined.select(
            "file", "row", "doc_id", "key", "size", "place", "source_size", "target", (F.col("base") + F.col("run")).alias("cumulative")
        ),
        "mix-finish",
    )


def _finish(copy: int) -> Column:
    given = F.col("source_size") * copy + F.col("cumulative")
    return F.when(F.col("target") > 0, given / F.col("target"))


def _position(copy: int) -> Column:
    return F.struct(_finish(copy).alias("finish"), F.col("place"), F.lit(copy).alias("copy"), F.col("key"))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """One row per document: file, row, doc_id, size, source_size, target, copies, taken."""
    timed = finish_times(docs, weights=weights, budget=budget, repeats=repeats)
    total, count = timed.agg(F.sum("size"), F.count(F.lit(1))).first()
    limit = budget * (total or 0)
    places = [_position(copy) for copy in range(repeats)]
    copies = timed.select("size", F.explode(F.array(*places)).alias("at")).filter("at.finish is not null")
    # Ranges of finish time; words are spread evenly over time 0 to 1 by construction.
    ranges = _slices(count)
    copies = copies.withColumn("range", F.floor(F.col("at.finish") * ranges))
    sums = copies.groupBy("range").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.orderBy("range"))
    # The first copy that no longer fits; only the one range that holds it is sorted.
    full = sums.select("range", (upto - F.col("words")).alias("base"), upto.alias("upto")).filter(F.col("upto") > limit)
    crossing = full.agg(F.min(F.struct("range", "base")).alias("at")).first()["at"]
    cut = None
    if crossing is not None:
        order = Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        there = copies.filter(F.col("range") == crossing["range"]).withColumn("reached", F.sum("size").over(order) + crossing["base"])
        cut = there.filter(F.col("reached") > limit).agg(F.min("at").alias("at")).first()["at"]
    fits = lambda at: F.lit(True) if cut is None else at < F.struct(*[F.lit(value) for value in cut])
    taken = sum(
        (F.when(place["finish"].isNotNull() & fits(place), 1).otherwise(0) for place in places),
        F.lit(0),
    )
    return timed.withColumn("copies", taken).select(
        "file", "row", "doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: ``docs`` with every row as often as it is taken."""
    docs = stored(docs)
    facts = mix(docs, **options).filter("copies > 0").select("file", "row", F.col("copies").alias("__copies"))
    rows = with_facts(docs, facts, "inner")
    again = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies")))
    return again.drop("__copies", "__copy")
