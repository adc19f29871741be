"""The tree as a stream: windows, moved directories, slices, restarts, ingest."""

import os
import subprocess
import sys
import time

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from firstseen import State
from firstseen.functions import globs
from firstseen.sources import tree, watch
from firstseen.streaming.dedup import ROCKSDB, STATE_STORE
from firstseen.streaming.tree import ingest_tree
from firstseen.workspace import setting
from tests.test_files import names, put

SETTLE_MS = 50


def delivered(rows, tmp_path, label="out"):
    """Run what has settled; (rel_path, size, mtime_ns, error) of the batch's rows."""
    time.sleep(3 * SETTLE_MS / 1_000)
    got = []
    keep = lambda batch, _: got.extend(batch.select("rel_path", "size", "mtime_ns", "error").collect())
    query = rows.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / label))
    query.trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, got))


def test_each_change_comes_with_the_next_batch(spark, tmp_path):
    root, outside = tmp_path / "src", tmp_path / "outside"
    root.mkdir()
    stamp = 1_700_000_000 * 10**9 + 7
    put(root, "a/plain", "x")
    put(root, ".hidden/empty", "")
    put(root, b"bad\xff", "b")
    os.symlink(root / "a", root / "link")
    put(outside, "moved/deep/old", "old")
    rows = watch.watch_tree(spark, str(root), settle_ms=SETTLE_MS)
    first = [(".hidden/empty", 0, stamp, None), ("a/plain", 1, stamp, None), ("bad�", 1, stamp, None)]
    assert delivered(rows, tmp_path) == first
    assert delivered(rows, tmp_path) == []
    # A directory that is moved in brings files that have not changed for long.
    os.rename(outside / "moved", root / "moved")
    put(root, "a/plain", "xyz")
    assert delivered(rows, tmp_path) == [("a/plain", 3, stamp, None), ("moved/deep/old", 3, stamp, None)]
    # A new query on the same checkpoint goes on where the last one stopped.
    put(root, "a/more", "m")
    again = watch.watch_tree(spark, str(root), ["!*.tmp"], settle_ms=SETTLE_MS)
    assert delivered(again, tmp_path) == [("a/more", 1, stamp, None)]


def test_rows_come_once(spark, tmp_path):
    root = tmp_path / "src"
    put(root, "new/dir/one", "1")
    with pytest.raises(ValueError, match="RocksDB"), setting(spark, STATE_STORE, "none"):
        watch.watch_tree(spark, str(root), once=True)
    with setting(spark, STATE_STORE, ROCKSDB):
        rows = watch.watch_tree(spark, str(root), once=True, settle_ms=SETTLE_MS)
        assert [r[0] for r in delivered(rows, tmp_path)] == ["new/dir/one"]
        # Both directories change, as if "dir" had been moved there.
        put(root, "new/two", "2")
        put(root, "new/dir/three", "3")
        assert [r[0] for r in delivered(rows, tmp_path)] == ["new/dir/three", "new/two"]


def walked(root, budget, after=-1, until=1 << 62, last=False):
    """Rows and work items of one round over the tree's root, or over given items."""
    items = root if isinstance(root, list) else [
        (os.fsencode(root), tree.PENDING, *[None] * 5, after, until, False, 0, 1)]
    top = os.fsencode(root) if not isinstance(root, list) else items[0][0]
    run = watch._walk_task(top, lambda _: False, None if last else budget)
    batches = run(iter([tree._batch(items, watch._WORK)]))
    rows = [tuple(row.values()) for row in pa.Table.from_batches(batches, watch._WORK).to_pylist()]
    return [r for r in rows if r[1] != tree.PENDING], [r for r in rows if r[1] == tree.PENDING]


@pytest.mark.parametrize("budget", [1, 3, 7, 1000])
def test_rounds_and_slices_lose_nothing(tmp_path, budget):
    expected = set()
    for number in range(40):
        expected.add(put(tmp_path, f"flat/{number}", "f"))
        expected.add(put(tmp_path, f"deep{number % 5}/{number % 3}/{number}", "d"))
    found, work = walked(tmp_path, budget)
    for turn in range(3):
        if work:
            more, work = walked(work, budget, last=turn == 2)
            found += more
    assert not work
    paths = [row[0] for row in found]
    assert len(paths) == len(set(paths)) and set(paths) == expected


def test_a_work_item_is_bounded(tmp_path):
    """No round opens more than its budget, but for the directories it has begun."""
    for number in range(200):
        put(tmp_path, f"flat/{number}", "f")
    found, work = walked(tmp_path, 10)
    assert not found and {row[0] for row in work} == {os.fsencode(tmp_path / "flat")}
    sizes = [len(walked([item], 10)[0]) for item in work]
    assert len(work) == 21 and sum(sizes) == 200 and max(sizes) <= 25


def test_unreadable_and_vanished(tmp_path, monkeypatch):
    put(tmp_path, "good", "g")
    put(tmp_path, "gone", "x")
    put(tmp_path, "shut/inside", "s")
    real = os.scandir

    def refuse(path):
        if os.fsencode(path).endswith(b"shut"):
            raise PermissionError("shut")
        return real(path)

    stat = os.lstat

    def vanish(path):
        if os.fsencode(path).endswith(b"gone"):
            raise FileNotFoundError("gone")
        return stat(path)

    monkeypatch.setattr(os, "scandir", refuse)
    monkeypatch.setattr(os, "lstat", vanish)
    found, _ = walked(tmp_path, 100)
    assert {(os.path.basename(r[0]), r[1], r[6]) for r in found} == {
        (b"good", "file", None), (b"gone", "file", "gone"), (b"shut", "dir", "shut")}


def test_continuous_ingest(spark, tmp_path):
    root, state, runs = tmp_path / "src", str(tmp_path / "state"), []
    put(root, "one", "same")
    put(root, "two", "other")

    def ingest():
        time.sleep(3 * SETTLE_MS / 1_000)
        ingest_tree(
            spark, str(root), str(tmp_path / "dst"), state, str(tmp_path / "checkpoint"), settle_ms=SETTLE_MS,
            on_batch=lambda _, run: runs.append({r.rel_path: (r.cache_result, r.outcome) for r in run.results.collect()}),
        ).awaitTermination()

    ingest()
    put(root, "later/three", "same")
    put(root, "two", "changed")
    ingest()
    ingest()
    assert runs == [
        {"one": ("new", "copied"), "two": ("new", "copied")},
        {"later/three": ("new", "skipped"), "two": ("modified", "failed")},
    ]
    assert names(tmp_path / "dst") == ["one", "two"]
    assert State(spark, state).ledger().filter(F.col("writer") == "batch").count() == 2


def test_tasks_need_no_install(tmp_path):
    """A process that cannot import the package runs the walk and the clock."""
    put(tmp_path, "tree/a/one", "1")
    root = os.fsencode(tmp_path / "tree")
    task = watch._walk_task(root, globs.dir_pruner(globs.parse_globs(["!cache/"]), True), 10)
    batch = tree._batch([(root, tree.PENDING, *[None] * 5, -1, 1 << 62, False, 0, 1)], watch._WORK)
    (tmp_path / "task").write_bytes(cloudpickle.dumps((task, batch, watch.TreeWindows)))
    code = """
import pickle, pyspark, sys
task, batch, source = pickle.load(open(sys.argv[1], "rb"))
print(sum(out.num_rows for out in task(iter([batch]))), source({}).streamReader(None).initialOffset()["until_ns"])
"""
    done = subprocess.run(
        [sys.executable, "-c", code, str(tmp_path / "task")], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert done.stdout.split() == ["1", "-1"]
