"""Classification, cache maintenance, counters, positions and payload fetch."""

import random

import pytest
from pyspark.sql import functions as F

from firstseen.functions import digest, paths
from firstseen.operators import cache as cache_ops
from firstseen.operators import classify, content, filters, order, payload, stats
from firstseen.schemas import CACHE

ENTRY = ("/test_path", 10, 20, 30)


def cache_frame(spark, *entries):
    rows = [(bytearray(p.encode()), s, m, c, bytearray(b"h")) for p, s, m, c in entries]
    frame = spark.createDataFrame(rows, "path_bytes binary, size bigint, mtime_ns bigint, ctime_ns bigint, content_hash binary")
    return frame.withColumn("path_hash", digest.path_digest(F.col("path_bytes"))).select(*CACHE.fieldNames())


def manifest_frame(spark, *entries):
    return cache_frame(spark, *entries).drop("content_hash").withColumn("path", paths.display(F.col("path_bytes")))


@pytest.mark.parametrize(
    "cached,looked_up,expected",
    [
        ([], ENTRY, ("new", None)),
        ([ENTRY], ENTRY, ("unchanged", bytearray(b"h"))),
        ([ENTRY], ("/test_path", 11, 22, 33), ("modified", None)),
        ([ENTRY], ("/test_path", 11, 20, 30), ("modified", None)),
        ([ENTRY], ("/test_path", 10, 21, 30), ("modified", None)),
        ([ENTRY], ("/test_path", 10, 20, 31), ("modified", None)),
        ([("/other", 10, 20, 30)], ENTRY, ("new", None)),
    ],
)
def test_classify(spark, cached, looked_up, expected):
    row = classify.classify(manifest_frame(spark, looked_up), cache_frame(spark, *cached)).first()
    assert (row["cache_result"], row["cached_hash"]) == expected


def test_upsert_delete_count(spark):
    cache = cache_frame(spark, ("/test_path_1", 1, 1, 1), ("/test_path_2", 2, 2, 2))
    listed = {bytes(r["path_bytes"]) for r in cache_ops.cached_paths(cache).collect()}
    assert listed == {b"/test_path_1", b"/test_path_2"}
    assert cache_ops.cached_path_count(cache).first()["cached_paths"] == 2
    merged = cache_ops.upsert(cache, cache_frame(spark, ("/test_path_2", 9, 9, 9), ("/test_path_3", 3, 3, 3)))
    assert {bytes(r["path_bytes"]): r["size"] for r in merged.collect()} == {b"/test_path_1": 1, b"/test_path_2": 9, b"/test_path_3": 3}
    left = cache_ops.delete(merged, cache_frame(spark, ("/test_path_1", 0, 0, 0)))
    assert classify.classify(manifest_frame(spark, ("/test_path_1", 1, 1, 1)), left).first()["cache_result"] == "new"


def test_cleanup_scope(spark):
    cache = cache_frame(spark, ("/s/a", 1, 1, 1), ("/s/gone", 1, 1, 1), ("/else/x", 1, 1, 1))
    marked = cache_ops.mark_present(cache, manifest_frame(spark, ("/s/a", 1, 1, 1)), "/s")
    assert {bytes(r["path_bytes"]) for r in cache_ops.keep_present(marked).collect()} == {b"/s/a", b"/else/x"}
    counts = cache_ops.cleanup_counts(marked).first()
    assert (counts["checked"], counts["removed"]) == (3, 1)


def test_row_errors(spark):
    rows = [("/a", 1, 1, None), ("b", 1, 1, None), ("/c", -1, 1, None), ("/d", 1, -1, None), ("/e", None, 1, None), ("/f", 1, 1, "gone")]
    frame = spark.createDataFrame(rows, "path string, mtime_ns bigint, ctime_ns bigint, error string")
    errors = {r["path"]: r["error"] for r in filters.with_errors(frame).collect()}
    assert errors == {
        "/a": None, "b": "path must be absolute", "/c": "modification time is before 1970",
        "/d": "creation time is before 1970", "/e": "no modification time", "/f": "gone",
    }


def test_stats_ignore_failed_rows(spark):
    rows = [("new", "copied", 5), ("modified", "skipped", 7), ("unchanged", "skipped", 0), ("new", "failed", 100)]
    row = stats.ingest_stats(spark.createDataFrame(rows, "cache_result string, outcome string, size bigint")).first()
    assert row.asDict() == {
        "total_files": 3, "total_bytes": 12, "new_files": 1, "new_bytes": 5, "modified_files": 1, "modified_bytes": 7,
        "unchanged_files": 1, "unchanged_bytes": 0, "copied_files": 1, "copied_bytes": 5, "skipped_files": 2,
        "skipped_bytes": 7, "failed_files": 1,
    }
    empty = spark.createDataFrame([], "cache_result string, outcome string, size bigint")
    assert set(stats.ingest_stats(empty).first()) == {0}


def test_sibling_positions(spark):
    rng = random.Random(3)
    # One directory holds most files, so it is cut over several slices.
    names = {f"/s/hot/{rng.randint(0, 10**6)}" for _ in range(800)} | {f"/s/d{i % 50}/f{i}" for i in range(200)} | {"/s/hot/a/b"}
    frame = spark.createDataFrame([(n, bytearray(n.encode())) for n in names], "path string, path_bytes binary")
    got = {r["path"]: r["position"] for r in order.sibling_positions(frame, slices=7).collect()}
    expected = {}
    for folder in {n.rsplit("/", 1)[0] for n in names}:
        inside = sorted(n for n in names if n.rsplit("/", 1)[0] == folder)
        expected.update({n: i + 1 for i, n in enumerate(inside)})
    assert got == expected
    in_order = [r["path"] for r in order.ordered(frame).collect()]
    assert in_order == sorted(names, key=lambda n: n.split("/"))


@pytest.mark.parametrize("bits", [0, 4, 21])
def test_payload_is_fetched_for_every_length_of_prefix(spark, monkeypatch, bits):
    monkeypatch.setattr(payload, "PREFIX_BITS", bits)
    decided = spark.range(100).select(
        digest.path_digest(F.col("id").cast("string")).alias("path_hash"),
        F.when(F.col("id") < 50, "copied").otherwise("skipped").alias("outcome"),
    )
    source = spark.range(100).withColumn(payload.KEY, digest.path_digest(F.col("id").cast("string")))
    wanted = F.col("outcome") == "copied"
    some = payload.thinned(source, decided, wanted)
    assert {r["id"] for r in some.collect()} >= set(range(50)) and (bits < 21 or some.count() == 50)
    got = payload.exactly(some, decided, wanted)
    assert sorted(r["id"] for r in got.collect()) == list(range(50))


def test_payload_plan_never_sorts_the_payload(spark):
    decided = spark.range(100).select(digest.path_digest(F.col("id").cast("string")).alias("path_hash"), F.lit("copied").alias("outcome"))
    source = spark.range(100).withColumn(payload.KEY, digest.path_digest(F.col("id").cast("string")))
    plan = payload.exactly(source, decided, F.col("outcome") == "copied")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in text and "Sort [" not in text


def test_classification_with_a_stored_size_reads_no_payload(spark, tmp_path):
    from firstseen.plans.tables import TableSource

    spark.range(50).select(F.concat(F.lit("/s/"), F.col("id").cast("string")).alias("p"), F.lit("text").alias("body"),
                           F.lit(4).alias("n")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    source = TableSource(table, F.col("p"), F.col("body"), F.lit(5).cast("bigint"), "/s", size=F.col("n"))
    plan = classify.classify(source.manifest(), cache_frame(spark, ENTRY))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p:string,n:int>" in plan


def test_no_cache_mode(spark):
    row = classify.classify_without_cache(manifest_frame(spark, ENTRY)).first()
    assert (row["cache_result"], row["cached_hash"]) == ("new", None)


def test_null_digests_are_no_content(spark):
    frame = spark.createDataFrame([(None,), (bytearray(b"x"),), (bytearray(b"x"),)], "content_hash binary")
    assert [bytes(r["content_hash"]) for r in content.distinct_contents(frame).collect()] == [b"x"]
