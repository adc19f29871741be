"""Merges of like-sized ledger runs, and the cache in layers."""

from math import log2

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from firstseen import State
from firstseen.operators import cache as cache_ops
from firstseen.operators import ledger
from firstseen.state import tiers


@pytest.fixture
def state(spark, tmp_path):
    return State(spark, str(tmp_path / "state"))


@given(st.lists(st.integers(1, 10**6), max_size=120), st.integers(2, 9))
def test_rows_are_rewritten_a_logarithmic_number_of_times(arriving, runs):
    """Each run is (size, [(first size, rewrites) of what went into it])."""
    held: list[tuple[int, list[tuple[int, int]]]] = []
    for size in arriving:
        held.append((size, [(size, 0)]))
        chosen = tiers.due([run[0] for run in held], runs)
        if chosen:
            parts = [(first, times + 1) for place in chosen for first, times in held[place][1]]
            total = sum(held[place][0] for place in chosen)
            held = [run for place, run in enumerate(held) if place not in chosen] + [(total, parts)]
    whole = sum(arriving)
    assert all(times <= log2(whole / first) for _, parts in held for first, times in parts)
    assert len(held) < runs or len(held) <= runs + log2(whole) + 1


@given(st.lists(st.integers(1, 1000), max_size=40), st.integers(2, 9))
def test_newest_runs_are_merged_without_a_larger_one(sizes, runs):
    count = tiers.due_newest(sizes, runs)
    assert count == 0 or count >= runs and 2 * max(sizes[-count:]) <= sum(sizes[-count:])


def test_sixty_four_equal_runs(spark, state, monkeypatch):
    """No row is rewritten more than six times; what a merge leaves out keeps its file."""
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("content_hash")
    depth: dict[str, int] = {}
    rewrite = State._rewrite_ledger

    def counted(self, df, names, size=None):
        run = rewrite(self, df, names, size)
        depth[f"ledger/writer=compact/run_id={run}"] = 1 + max(depth.get(name, 0) for name in names)
        return run

    monkeypatch.setattr(State, "_rewrite_ledger", counted)
    merges = 0
    for run in range(64):
        state.append_ledger(ledger.entries(spark.range(run * 20, run * 20 + 20, 1, 1).select(digest), run))
        before = set(state._runs())
        if state.tend_ledger() is not None:
            merges += 1
            assert len(before - set(state._runs())) >= 8
    assert merges >= 5 and max(depth.values()) <= 6
    assert len(state._runs()) < 16 and state.next_run() == 64
    rows = state.ledger()
    assert rows.count() == rows.select("content_hash").distinct().count() == 64 * 20
    assert rows.filter("copied_time = 63").count() == 20


def test_replayable_runs_are_not_merged(spark, state):
    entry = lambda name: ledger.entries(spark.createDataFrame([(bytearray(name.encode()),)], "content_hash binary"), 1)
    for batch in range(5):
        state.append_ledger(entry(f"s{batch}"), "stream", batch)
    assert state.tend_ledger({"stream": 1}, runs=2) is None
    assert state.tend_ledger({"stream": 4}, runs=2) is not None
    assert {bytes(r["content_hash"]) for r in state.ledger(replaying=("stream", 4)).collect()} == {b"s0", b"s1", b"s2", b"s3"}
    assert state.ledger().count() == 5


def entry(spark, low, high, size):
    key = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    return spark.range(low, high, 1, 2).select(
        key.alias("path_hash"), F.concat(F.lit("/p/"), "id").cast("binary").alias("path_bytes"), F.lit(size).cast("long").alias("size"),
        F.lit(0).cast("long").alias("mtime_ns"), F.lit(0).cast("long").alias("ctime_ns"), key.alias("content_hash"),
    )


def held(state):
    rows = state.cache().collect()
    found = {int(bytes(r["path_bytes"])[3:]): r["size"] for r in rows}
    assert len(found) == len(rows) and state.cache().columns == cache_ops._COLUMNS
    return found


def test_a_small_change_writes_a_small_layer(spark, state):
    """One percent of 20,000 entries changes: the other files are carried by name."""
    state.change_cache(entry(spark, 0, 20_000, 1))
    before = set(state.cache().inputFiles())
    whole = state.folder.bytes("cache/snapshot=0")
    number = state.change_cache(entry(spark, 0, 200, 2), entry(spark, 300, 310, 0).select("path_hash"))
    assert before <= set(state.cache().inputFiles())
    assert state.folder.bytes(f"cache/snapshot={number}") < 0.05 * whole
    sizes = held(state)
    assert sizes == {i: 2 if i < 200 else 1 for i in range(20_000) if not 300 <= i < 310}
    # A removed path may come back.
    state.change_cache(entry(spark, 305, 306, 3))
    assert held(state) == {**sizes, 305: 3}


def test_layers_equal_a_dictionary(spark, state):
    """Many changes, merges among the newest layers and into the oldest, against the plain rules."""
    model = {i: 0 for i in range(2_000)}
    state.change_cache(entry(spark, 0, 2_000, 0))
    written = []
    for step in range(1, 24):
        low = step * 37 % 1_900
        state.change_cache(entry(spark, low, low + 30, step), entry(spark, low + 40, low + 50, 0).select("path_hash"))
        model |= {i: step for i in range(low, low + 30)}
        for i in range(low + 40, low + 50):
            model.pop(i, None)
        written.append(len(state._layers()))
        if step % 6 == 0:
            assert held(state) == model
    assert held(state) == model
    assert max(written) <= 12 and any(b < a for a, b in zip(written, written[1:]))


def test_uncommitted_layer_is_ignored_and_frames_read_on(spark, state, monkeypatch):
    state.change_cache(entry(spark, 0, 500, 1))
    before = state.cache()
    with monkeypatch.context() as patch:  # a crash between the layer's data and its commit
        patch.setattr(type(state.folder), "write_once", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            state.change_cache(entry(spark, 0, 3, 2))
    assert set(held(state).values()) == {1}
    state.change_cache(entry(spark, 0, 2, 3))
    assert {i for i, size in held(state).items() if size == 3} == {0, 1}
    state.write_cache(entry(spark, 0, 5, 9))
    assert before.count() == 500 and len(held(state)) == 5


def test_nothing_to_change(spark, state):
    with pytest.raises(ValueError):
        state.change_cache()
    state.change_cache(gone=entry(spark, 0, 5, 0).select("path_hash"))
    assert state.cache().count() == 0
