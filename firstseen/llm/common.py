"""Helpers that several operators of this subpackage share.

``spread_join`` and ``components`` hold for any distribution of keys: a key that
more than 1 / SHARE of the rows carry is *heavy*, so fewer than SHARE keys can
be heavy, and only those are ever broadcast. Everything else is shuffled, and no
other key is larger than 1 / SHARE of the rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstseen.workspace import discard, stage

SHARE = 10_000


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            discard(table.sparkSession, path)


def spread_join(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``facts`` on ``key``; no key's rows meet in one task.

    ``rows`` must be staged (it is read three times) and hold no null key;
    ``facts`` has at most one row per key. ``how`` is ``inner`` or ``left``.
    """
    total = rows.count()
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    heavy = stage(counts.filter(F.col("__n") * SHARE > total).select(key), "heavy-keys")
    heavy_facts = facts.join(F.broadcast(heavy), key, "left_semi")
    hot = rows.join(F.broadcast(heavy), key, "left_semi").join(F.broadcast(heavy_facts), key, how)
    cold = rows.join(F.broadcast(heavy), key, "left_anti").join(facts, key, how)
    return hot.unionByName(cold)


def salted_join(rows: DataFrame, facts: DataFrame, key: str, by: list[str]) -> DataFrame:
    """``rows`` joined to ``facts`` on ``key``, heavy keys dealt out over salts.

    For rows that are many per key and cheap to move: they are read once, and a key
    with a share of the rows is cut into as many parts, by the hash of ``by``, as
    keep each below 1 / SHARE of them; its one fact is copied to each part.
    """
    total = rows.count()
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") * SHARE > total)
    salts = F.ceil(F.col("__n") * SHARE / F.lit(max(total, 1))).cast("int")
    heavy = stage(counts.select(key, salts.alias("__salts")), "heavy-keys")
    spread = F.coalesce("__salts", F.lit(1))
    salted = rows.join(F.broadcast(heavy), key, "left").withColumn("__salt", F.pmod(F.xxhash64(*by), spread).cast("int"))
    copied = facts.join(F.broadcast(heavy), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), spread - 1)))
    return salted.drop("__salts").join(copied.drop("__salts"), [key, "__salt"]).drop("__salt")


def located(docs: DataFrame, *columns) -> DataFrame:
    """``columns`` of ``docs`` plus ``file`` and ``row``: where each row is stored.

    The pair is unique and stable for rows read from Parquet. Any other frame is
    written to the shared folder first, which gives its rows a place.
    """
    try:
        return _located(docs, columns)
    except AnalysisException:
        return _located(stage(docs, "rows"), columns)


def _located(docs: DataFrame, columns) -> DataFrame:
    place = docs.metadataColumn("_metadata")
    return docs.select(*columns, place["file_path"].alias("file"), place["row_index"].alias("row"))


def stored(docs: DataFrame) -> DataFrame:
    """``docs`` itself if its rows have a place, else a stored copy."""
    try:
        _located(docs, ())
        return docs
    except AnalysisException:
        return stage(docs, "rows")


def with_facts(docs: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """All columns of ``docs`` (from ``stored``) joined to ``facts`` by place.

    ``facts`` has (file, row) and its own columns under names starting with two
    underscores, so that they cannot clash with the rows' own. Places are unique
    and spread evenly; whole rows are shuffled once and not sorted.
    """
    place = docs.metadataColumn("_metadata")
    rows = docs.select("*", place["file_path"].alias("__file"), place["row_index"].alias("__row"))
    facts = facts.withColumnsRenamed({"file": "__file", "row": "__row"}).hint("shuffle_hash")
    return rows.join(facts, ["__file", "__row"], how).drop("__file", "__row")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): (node, root), one row per node.

    Rounds of contraction: every node joins the neighbour (or itself) with the
    smallest hash of that round, and the edges between the joined nodes make the
    next, smaller graph. Fresh hashes in each round keep long chains from taking
    more than a logarithmic number of rounds. The maps of all rounds, composed
    backwards, give the root. Every table is staged, the driver sees one count
    per round.
    """
    edges = stage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), c).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        best = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        parents = stage(best.select(F.col("a").alias("node"), F.least("best", rank("a"))["v"].alias("parent")), "parents")
        first = spread_join(edges.withColumnRenamed("a", "node"), parents, "node")
        half = stage(first.select(F.col("b").alias("node"), F.col("parent").alias("a")), "half")
        moved = spread_join(half, parents, "node").select("a", F.col("parent").alias("b"))
        pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = stage(moved.filter("a <> b").select(*pair).distinct(), "edges")
        maps.append(parents)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps.pop()
    roots = roots.withColumnRenamed("parent", "root")
    while maps:
        upper = roots.select(F.col("node").alias("parent"), "root")
        joined = spread_join(maps.pop(), upper, "parent", "left")
        roots = stage(joined.select("node", F.coalesce("root", "parent").alias("root")), "roots")
    return roots
