"""Ledger and cache on disk."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from firstseen import State
from firstseen.operators import ledger


def hashes(spark, *names):
    return spark.createDataFrame([(bytearray(n.encode()),) for n in names], "content_hash binary")


def entries(spark, now, *names):
    return ledger.entries(hashes(spark, *names), now)


def held(state, **kw):
    return {bytes(r["content_hash"]).decode(): r["copied_time"] for r in state.ledger(**kw).collect()}


@pytest.fixture
def state(spark, tmp_path):
    return State(spark, str(tmp_path / "state"))


def test_empty_state(state):
    assert state.ledger().count() == 0 and state.cache().count() == 0


def test_append_and_lookup(spark, state):
    assert state.append_ledger(entries(spark, 101112, "a", "a")) == 0
    assert state.append_ledger(ledger.new_entries(hashes(spark, "a", "b"), state.ledger(), 5)) == 1
    assert held(state) == {"a": 101112, "b": 5} and state.ledger().count() == 2
    rows = {(r["writer"], r["run_id"]) for r in state.ledger().collect()}
    assert rows == {("batch", 0), ("batch", 1)}


def test_uncommitted_run_is_ignored(spark, state):
    state.append_ledger(entries(spark, 1, "a"))
    entries(spark, 1, "b").write.parquet(state.folder.path("ledger/writer=batch/run_id=1"))
    assert held(state) == {"a": 1}
    with pytest.raises(Exception):
        state.append_ledger(entries(spark, 1, "c"), run_id=1)


def test_compaction_keeps_the_earliest_time(spark, state):
    state.append_ledger(entries(spark, 7, "a", "b"))
    state.append_ledger(entries(spark, 3, "b", "c"), "stream", 0)
    state.append_ledger(entries(spark, 9, "d"), "stream", 1)
    assert state.compact_ledger(min_runs=3) is None
    state.compact_ledger({"stream": 1})
    assert held(state) == {"a": 7, "b": 3, "c": 3, "d": 9} and state.ledger().count() == 4
    assert {(r["writer"], r["run_id"]) for r in state.ledger().collect()} == {("compact", 0), ("stream", 1)}


def test_crash_between_compaction_and_deletion(spark, state, monkeypatch):
    state.append_ledger(entries(spark, 1, "a", "b"))
    state.append_ledger(entries(spark, 2, "c"))
    with monkeypatch.context() as patch:
        patch.setattr(type(state.folder), "delete", lambda *_: None)
        state.forget(hashes(spark, "a"))
    # The old directories are still there, but the new one replaces them.
    assert held(state) == {"b": 1, "c": 2}
    assert len(state.folder.subfolders("ledger/writer=batch")) == 2


def test_forget_everything_and_again(spark, state):
    state.append_ledger(entries(spark, 1, "a"))
    state.forget(hashes(spark, "a", "zzz"))
    assert held(state) == {}
    assert state.append_ledger(entries(spark, 2, "a")) == 1
    assert held(state) == {"a": 2}
    state.append_ledger(entries(spark, 3, "b"))
    state.compact_ledger()
    assert state.next_run() == 3 and held(state) == {"a": 2, "b": 3}


def test_replay_hides_own_runs(spark, state):
    state.append_ledger(entries(spark, 1, "a"))
    state.append_ledger(entries(spark, 2, "b"), "s", 0)
    state.append_ledger(entries(spark, 3, "c"), "s", 1)
    assert set(held(state, replaying=("s", 1))) == {"a", "b"}
    state.append_ledger(entries(spark, 4, "c"), "s", 1, replay=True)
    assert held(state) == {"a": 1, "b": 2, "c": 4}


def test_cache_snapshots(spark, state):
    def frame(size):
        return spark.range(3).select(
            F.col("id").cast("string").cast("binary").alias("path_hash"), F.lit(b"/p").alias("path_bytes"),
            F.lit(size).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("mtime_ns"),
            F.lit(0).cast("bigint").alias("ctime_ns"), F.lit(b"h").alias("content_hash"),
        )

    for size in range(4):
        assert state.write_cache(frame(size)) == size
    frame(9).write.parquet(state.folder.path("cache/snapshot=4"))  # never committed
    assert {r["size"] for r in state.cache().collect()} == {3}
    assert state.folder.subfolders("cache") == ["snapshot=2", "snapshot=3", "snapshot=4"]
    state.write_cache(state.cache())
    assert {r["size"] for r in state.cache().collect()} == {3}


def test_second_batch_writer_fails(spark, state, tmp_path):
    run = state.open_run()
    second = State(spark, str(tmp_path / "state"))
    assert second.open_run() == run  # nothing is placed yet: whoever places first goes on
    state.mark_placing(run)
    with pytest.raises(Py4JJavaError, match="exists"):
        second.mark_placing(run)
    with pytest.raises(RuntimeError, match="unfinished"):
        State(spark, str(tmp_path / "state")).open_run()
    state.close_run(run)
    assert state.open_run() == run + 1


def test_resume_keeps_a_run_it_did_not_write(spark, tmp_path):
    """A preload without a claim, then a crashed run: the preload's rows stay."""
    state = State(spark, str(tmp_path / "state"))
    preload = state.append_ledger(spark.createDataFrame([(b"a" * 32, 1)], "content_hash binary, copied_time long"))
    run = state.open_run()
    assert run > preload
    assert State(spark, str(tmp_path / "state")).open_run(resume=True) == run
    assert state.ledger().count() == 1


def test_resume_over_a_foreign_committed_run(spark, tmp_path):
    state = State(spark, str(tmp_path / "state"))
    run = state.open_run()
    state._claims.clear()
    state.append_ledger(spark.createDataFrame([(b"a" * 32, 1)], "content_hash binary, copied_time long"), run_id=run)
    assert State(spark, str(tmp_path / "state")).open_run(resume=True) == run + 1
    assert state.ledger().count() == 1


def test_forgotten_stays_forgotten_after_an_interrupted_rewrite(spark, tmp_path, monkeypatch):
    entry = lambda *keys: spark.createDataFrame([(k * 32, 1) for k in keys], "content_hash binary, copied_time long")
    state = State(spark, str(tmp_path / "state"))
    state.append_ledger(entry(b"a", b"b"))
    state.append_ledger(entry(b"c"))
    monkeypatch.setattr(type(state.folder), "delete", lambda self, name: None)  # a crash between commit and delete
    state.forget(entry(b"a").select("content_hash"))
    monkeypatch.undo()
    state.append_ledger(entry(b"d"))
    state.compact_ledger()
    left = sorted(bytes(r.content_hash[:1]) for r in state.ledger().collect())
    assert left == [b"b", b"c", b"d"]


def test_rewrites_keep_one_generation_for_readers(spark, state):
    state.append_ledger(entries(spark, 1, "a", "b"))
    state.append_ledger(entries(spark, 2, "c"))
    before = state.ledger()
    state.compact_ledger()
    assert before.count() == 3 and state.ledger().count() == 3
    state.append_ledger(entries(spark, 3, "d"))
    state.compact_ledger()
    assert state.folder.subfolders("ledger/writer=batch") == ["run_id=2"]
    assert held(state) == {"a": 1, "b": 1, "c": 2, "d": 3}
    state.append_ledger(entries(spark, 4, "e"))
    assert state.next_run() == 4 and state.ledger().count() == 5


def scanned(df):
    """Rows that the scan of a query without shuffles passed on when it was collected."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_lookups_read_the_pages_of_their_digests(spark, state):
    """100 lookups, half of them known, in a ledger of half a million digests over two runs and a compaction."""
    digest = lambda low, high: spark.range(low, high).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("content_hash"))
    state.append_ledger(ledger.entries(digest(0, 200_000), 1))
    state.append_ledger(ledger.entries(digest(200_000, 400_000), 2))
    asked = [bytes(r[0]) for r in digest(0, 500_000).collect()][::5_000] + [b"", b"\xff" * 32]
    for compacted in (False, True):
        found = ledger.lookup(state.ledger(), asked)
        rows = found.collect()
        assert sorted(r["copied_time"] for r in rows) == [1] * 40 + [2] * 40 and {bytes(r["content_hash"]) for r in rows} == set(asked[:80])
        # At most a page of 400 rows for each digest and file; after a compaction for each digest.
        files = 1 if compacted else len(state.ledger().inputFiles())
        assert scanned(found) <= min(400_000, len(asked) * files * 400)
        one = ledger.lookup(state.ledger(), asked[:1])
        assert len(one.collect()) == 1 and scanned(one) <= 400
        assert compacted or state.compact_ledger() is not None
    assert ledger.lookup(state.ledger(), []).count() == 0
    with pytest.raises(ValueError):
        ledger.lookup(state.ledger(), [str(i).encode() for i in range(ledger.LOOKUPS + 1)])


def test_small_and_large_batches_find_the_same_memory(spark, state, tmp_path, monkeypatch):
    state.append_ledger(entries(spark, 1, *"abcdef"))
    batch = hashes(spark, *"aabzy").unionByName(spark.createDataFrame([(None,)], "content_hash binary"))
    batch.write.parquet(str(tmp_path / "batch"))
    batch = spark.read.parquet(str(tmp_path / "batch"))
    small = sorted(bytes(r["content_hash"]) for r in ledger.relevant(state.ledger(), batch).collect())
    monkeypatch.setattr(ledger, "LOOKUPS", 2)
    large = sorted(bytes(r["content_hash"]) for r in ledger.relevant(state.ledger(), batch).collect())
    assert small == large == [b"a", b"b"]
