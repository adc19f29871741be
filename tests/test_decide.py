"""The decision and the content joins against a one-by-one model."""

import random

import pytest
from pyspark.sql import functions as F

from firstseen.operators import content
from firstseen.operators.classify import classify
from firstseen.operators.order import sibling_positions
from firstseen.schemas import CACHE
from firstseen.workspace import stage


def rows_frame(spark, rows):
    """rows: (path, content or None, eligible, known)"""
    data = [(p, bytearray(p.encode()), None if c is None else bytearray(c.encode()), e, k, 1) for p, c, e, k in rows]
    return spark.createDataFrame(
        data, "path string, path_bytes binary, content_hash binary, eligible boolean, known boolean, size bigint"
    )


def ledger_frame(spark, contents):
    return spark.createDataFrame([(bytearray(c.encode()), 5) for c in contents], "content_hash binary, copied_time bigint")


def one_by_one(rows, known):
    """Visit files in path order; remember content only after a good copy."""
    memory, outcome = set(known), {}
    for path, text, eligible, _ in sorted(rows, key=lambda r: r[0].split("/")):
        if text is None:
            outcome[path] = "failed"
        elif text in memory:
            outcome[path] = "skipped"
        elif not eligible:
            outcome[path] = "failed"
        else:
            outcome[path] = "copied"
            memory.add(text)
    return outcome, memory


def outcomes(df):
    return {r["path"]: r["outcome"] for r in df.select("path", "outcome").collect()}


@pytest.mark.parametrize(
    "rows,known,expected",
    [
        ([("a", "x", True, False)], [], ["copied"]),
        ([("a", "x", True, False)], ["x"], ["skipped"]),
        ([("a", "x", False, False)], [], ["failed"]),
        ([("a.txt", "x", True, False), ("b.txt", "x", True, False)], [], ["copied", "skipped"]),
        ([("a.txt", "x", False, False), ("b.txt", "x", True, False)], [], ["failed", "copied"]),
        ([("a.txt", "x", False, False), ("b.txt", "x", False, False)], [], ["failed", "failed"]),
        ([("a", "x", False, False)], ["x"], ["skipped"]),
        ([("a.txt", "x", True, False), ("a/b", "x", True, False)], [], ["skipped", "copied"]),
        ([("a", None, True, False), ("b", None, True, False)], [], ["failed", "failed"]),
        ([("a", "", True, False), ("b", "", True, False)], [], ["copied", "skipped"]),
        ([], [], []),
    ],
)
def test_fixtures(spark, rows, known, expected):
    got = outcomes(content.decide(rows_frame(spark, rows), ledger_frame(spark, known)))
    assert [got[r[0]] for r in rows] == expected


@pytest.mark.parametrize("seed", range(4))
def test_random_runs_with_carried_memory(spark, seed):
    rng = random.Random(seed)
    memory = set()
    for _ in range(3):
        paths = {"/".join(rng.choices(["a", "b", "a.", "B", "c1"], k=rng.randint(1, 5))) for _ in range(150)}
        # One content holds about a third of all rows.
        texts = ["hot"] * 10 + [f"t{i}" for i in range(20)] + [None]
        rows = [(p, rng.choice(texts), rng.random() < 0.6, False) for p in paths]
        expected, after = one_by_one(rows, memory)
        frame, ledger = rows_frame(spark, rows), ledger_frame(spark, memory)
        for hot_parts in (3, 50, 10_000):
            assert outcomes(content.decide(frame, ledger, hot_parts)) == expected
        marked = content.mark_known(frame.drop("known"), ledger)
        assert outcomes(content.decide(marked)) == expected
        memory = after


def test_content_joins(spark):
    rows = [(f"p{i:03}", "hot" if i % 3 == 0 else f"t{i}", True, False) for i in range(90)] + [("n", None, True, False)]
    frame = rows_frame(spark, rows)  # its own ``known`` column must survive
    ledger = ledger_frame(spark, ["hot", "t1", "absent", "hot"])
    known = {r[0] for r in rows if r[1] in ("hot", "t1")}
    names = lambda df: [r["path"] for r in df.collect()]
    for hot_parts in (1, 4, 10_000):
        got = names(content.known_content(frame, ledger, hot_parts))
        assert len(got) == len(known) and set(got) == known
        assert content.known_content(frame, ledger, hot_parts).columns.count("known") == 1
        got = names(content.unseen_content(frame, ledger, hot_parts))
        assert len(got) == 90 - len(known) and not set(got) & known
        marked = {r["path"]: r["known"] for r in content.mark_known(frame, ledger, hot_parts).collect()}
        assert len(marked) == 91 and {p for p, k in marked.items() if k} == known
        found = content.seen_lookup(frame, ledger, hot_parts).collect()
        assert {r["path"] for r in found} == known and len(found) == len(known) and {r["copied_time"] for r in found} == {5}


def test_dedup_and_groups(spark):
    rows = [("a.txt", "x", True, False), ("a/b", "x", True, False), ("c", "y", True, False), ("d", None, True, False)]
    frame = rows_frame(spark, rows)
    kept = {r["path"] for r in content.dedup_exact(frame.filter("content_hash is not null"), "size").collect()}
    assert kept == {"a/b", "c"}
    groups = content.duplicate_groups(frame).collect()
    assert [(g["n_files"], g["n_bytes"], g["first_path"]) for g in groups] == [(2, 2, "a/b")]


def test_hot_content_is_spread(spark):
    """One content has a third of the rows: no task may hold all of it."""
    path = F.concat(F.lit("/s/"), F.col("id").cast("string"))
    text = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
    frame = spark.range(30_000).select(
        path.alias("path"), path.cast("binary").alias("path_bytes"), text.cast("binary").alias("content_hash"),
        F.lit(True).alias("eligible"), F.lit(False).alias("known"),
    )
    frame = stage(frame, "hot")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        decided = content.decide(frame).cache()
        hot = decided.filter(F.col("content_hash") == F.lit("hot").cast("binary"))
        per_task = [r["count"] for r in hot.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per_task) == 10_000 and max(per_task) < 10_000 / 4
        assert hot.filter("outcome = 'copied'").count() == 1
        assert decided.filter("outcome = 'copied'").count() == 20_001
        decided.unpersist()
        plan = content.decide(frame)._jdf.queryExecution().executedPlan().toString()
        assert "partial_min" in plan and plan.count("BroadcastHashJoin") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_leading(spark):
    rows = [(f"{i:03}", "hot" if i % 2 else f"t{i % 6}", True, False) for i in range(100)]
    got = sorted(r["path"] for r in content.leading(rows_frame(spark, rows), 3).collect())
    expected = []
    for text in {r[1] for r in rows}:
        expected += sorted(r[0] for r in rows if r[1] == text)[:3]
    assert got == sorted(expected)


def test_rows_without_a_path_are_spread(spark):
    """A third of the rows has neither path nor digest: no task of a join may hold all of them."""
    frame = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, F.sha2(F.col("id").cast("string"), 256).cast("binary")).alias("path_hash"),
        F.lit(None).cast("binary").alias("path_bytes"), F.lit(None).cast("binary").alias("content_hash"),
        F.col("id").alias("size"), F.col("id").alias("mtime_ns"), F.lit(0).cast("bigint").alias("ctime_ns"),
        F.lit(False).alias("eligible"), F.lit(False).alias("known"),
    )
    frame = stage(frame, "pathless")
    cache = spark.createDataFrame([], CACHE)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for joined in (classify(frame, cache), content.decide(frame)):
            lost = joined.filter(F.col("path_hash").isNull()).groupBy(F.spark_partition_id()).count().collect()
            assert sum(r["count"] for r in lost) == 10_000 and max(r["count"] for r in lost) < 10_000 / 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_slices_follow_the_rows(spark, monkeypatch):
    """One directory with all files: no task ranks more than its share."""
    monkeypatch.setattr("firstseen.operators.order.SLICE_ROWS", 500)
    path = F.format_string("/s/%05d", "id")
    frame = spark.range(10_000).select(path.alias("path"), path.cast("binary").alias("path_bytes"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = sibling_positions(frame)
        per_task = placed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert placed.select(F.format_string("/s/%05d", F.col("position") - 1) == F.col("path")).distinct().collect() == [(True,)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert per_task < 10_000 / 2
