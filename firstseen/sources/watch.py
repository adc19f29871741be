"""A source tree as a stream: each batch holds the files that came or changed since the last.

The offset is a time, so it stays one number whatever the tree holds. A batch covers the
window (after, until] and delivers every file whose change time (the inode's, which
creation, writing and renaming set and nobody can set back) lies in it. A file that changes
again while its batch runs is past the window and comes with the next one.

A directory that is moved into the tree brings files whose own change times are old. Moving
sets the change time of the directory and of its new parent, so once the earlier of the two
lies in the window, everything below is delivered. Adding entries to both sets them as well:
delivery is at least once, and ``once=True`` makes it exactly once.

The walk is part of the batch's plan: a few rounds of listing with a budget of entries each
and a shuffle of what is still to be opened between them. A task reads metadata where it
lists, so only open work and changed files travel. A directory with more entries than the
budget is cut into slices by a hash of the names.

Edge cases: an empty tree gives no rows; links are not followed; a file that vanishes or
cannot be read gives a row with ``error``; a directory that cannot be read gives a row of kind
``dir`` in every batch, and what lies below comes when it changes once it can be read again.
"""

from __future__ import annotations

import os
import time
import zlib
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from firstseen.functions import globs as glob_rules
from firstseen.functions import paths
# Names, not the module: tasks take functions along by value, a module they would have to import.
from firstseen.sources.tree import (
    _BATCH, DIRECTORY, FILE, LIST_BUDGET, PENDING, _batch, _birth_time_reader, described,
)
from firstseen.streaming.dedup import check_state_store

# Listing rounds of a batch; the last one has no budget. Three rounds with a budget reach
# LIST_BUDGET ** 3 entries.
ROUNDS = 4
# A change time may lag behind the clock by a tick of the kernel, or by the skew of a file server.
SETTLE_MS = 1_000

_WORK = pa.schema([
    ("path_bytes", pa.binary()), ("kind", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64()),
    ("ctime_ns", pa.int64()), ("changed_ns", pa.int64()), ("error", pa.string()), ("after_ns", pa.int64()),
    ("until_ns", pa.int64()), ("fresh", pa.bool_()), ("slice", pa.int32()), ("slices", pa.int32()),
])
_WORK_DDL = (
    "path_bytes binary, kind string, size bigint, mtime_ns bigint, ctime_ns bigint, changed_ns bigint, error string, "
    "after_ns bigint, until_ns bigint, fresh boolean, slice int, slices int"
)


class _Window(InputPartition):
    def __init__(self, after_ns: int, until_ns: int):
        super().__init__(0)
        self.after_ns, self.until_ns = after_ns, until_ns


class _Clock(DataSourceStreamReader):
    def __init__(self, settle_ms: int):
        self.settle_ms = settle_ms

    def initialOffset(self) -> dict:
        return {"until_ns": -1}

    def latestOffset(self) -> dict:
        return {"until_ns": time.time_ns() - self.settle_ms * 1_000_000}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [_Window(start["until_ns"], end["until_ns"])]

    def read(self, partition: _Window) -> Iterator[tuple[int, int]]:
        # A clock that was set back gives an empty window, not a second delivery.
        if partition.until_ns > partition.after_ns:
            yield partition.after_ns, partition.until_ns


class TreeWindows(DataSource):
    """The time windows of a watched tree, one row a batch."""

    @classmethod
    def name(cls) -> str:
        return "tree_windows"

    def schema(self) -> str:
        return "after_ns bigint, until_ns bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Clock(int(self.options.get("settle_ms", SETTLE_MS)))


def _found(path: bytes, info: os.stat_result, birth_time) -> tuple:
    size, mtime_ns, born, error = described(path, info, birth_time)
    return path, FILE, size, mtime_ns, born, info.st_ctime_ns, error, None, None, None, None, None


def _broken(path: bytes, kind: str, problem: OSError) -> tuple:
    return path, kind, None, None, None, None, str(problem), None, None, None, None, None


def _walk_task(root: bytes, pruned, budget: int | None):
    """One round for mapInArrow: opens the pending directories, passes files on."""
    prefix = len(root.rstrip(b"/")) + 1

    def entries(directory: bytes, part: int, parts: int) -> Iterator[os.DirEntry]:
        with os.scandir(directory) as listing:
            for entry in listing:
                if parts == 1 or zlib.crc32(entry.name) % parts == part:
                    yield entry

    def walk(start: bytes, after: int, until: int, fresh: bool, part: int, parts: int, birth_time) -> Iterator[tuple]:
        def work(directory, fresh, part=0, parts=1):
            return directory, PENDING, None, None, None, None, None, after, until, fresh, part, parts

        queue, seen = deque([(start, fresh, part, parts)]), 0
        while queue:
            if budget is not None and seen >= budget:
                yield from (work(*waiting) for waiting in queue)
                return
            directory, fresh, part, parts = queue.popleft()
            try:
                own = os.stat(directory).st_ctime_ns
                inside = entries(directory, part, parts)
                if budget is not None and parts == 1:
                    kept, total = [], 0
                    for entry in inside:
                        total += 1
                        if total <= budget:
                            kept.append(entry)
                    if total > budget:
                        cut = -(-total // budget) + 1
                        yield from (work(directory, fresh, index, cut) for index in range(cut))
                        seen += budget
                        continue
                    inside = iter(kept)
                for entry in inside:
                    seen += 1
                    try:
                        if entry.is_file(follow_symlinks=False):
                            info = os.lstat(entry.path)
                            if info.st_ctime_ns <= until and (fresh or info.st_ctime_ns > after):
                                yield _found(entry.path, info, birth_time)
                        elif entry.is_dir(follow_symlinks=False):
                            if not pruned(entry.path[prefix:].decode("utf-8", "replace")):
                                moved = min(own, os.lstat(entry.path).st_ctime_ns)
                                queue.append((entry.path, fresh or after < moved <= until, 0, 1))
                    except OSError as problem:
                        yield _broken(entry.path, FILE, problem)
            except OSError as problem:
                yield _broken(directory, DIRECTORY, problem)

    def run(batches):
        birth_time = _birth_time_reader()
        for batch in batches:
            waiting = pc.equal(batch.column(1), PENDING)
            done = batch.filter(pc.invert(waiting))
            if done.num_rows:
                yield done
            rows = []
            items = batch.filter(waiting).select(["path_bytes", "after_ns", "until_ns", "fresh", "slice", "slices"])
            for item in items.to_pylist():
                for row in walk(*item.values(), birth_time):
                    rows.append(row)
                    if len(rows) >= _BATCH:
                        yield _batch(rows, _WORK)
                        rows = []
            if rows:
                yield _batch(rows, _WORK)

    return run


def watch_tree(
    spark: SparkSession,
    source: str,
    globs: Sequence[str] = (),
    ignore_hidden: bool = False,
    *,
    once: bool = False,
    settle_ms: int = SETTLE_MS,
    budget: int = LIST_BUDGET,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Streaming MANIFEST of ``source``, with ``kind`` and ``changed_ns``.

    The trigger's interval is how often the tree is walked. Files younger than ``settle_ms``
    wait for the next batch. ``once`` remembers path and change time of every delivered row
    in keyed state on disk, without expiry; the session's state store must be RocksDB then.
    """
    parsed = glob_rules.parse_globs(globs)
    root = os.path.realpath(source)
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    if once:
        check_state_store(spark)
    root_bytes = os.fsencode(root)
    pruned = glob_rules.dir_pruner(parsed, ignore_hidden)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    spark.dataSource.register(TreeWindows)
    windows = spark.readStream.format(TreeWindows.name()).option("settle_ms", settle_ms).load()
    null = {name: F.lit(None).cast(kind) for name, kind in (
        ("size", "bigint"), ("mtime_ns", "bigint"), ("ctime_ns", "bigint"), ("changed_ns", "bigint"), ("error", "string"),
    )}
    rows = windows.select(
        F.lit(bytearray(root_bytes)).alias("path_bytes"), F.lit(PENDING).alias("kind"),
        *[column.alias(name) for name, column in null.items()], "after_ns", "until_ns",
        F.lit(False).alias("fresh"), F.lit(0).alias("slice"), F.lit(1).alias("slices"),
    )
    for number in range(rounds):
        if number:
            rows = rows.repartition(tasks, "path_bytes", "slice")
        rows = rows.mapInArrow(_walk_task(root_bytes, pruned, budget if number < rounds - 1 else None), _WORK_DDL)
    rel = paths.display(paths.relative_bytes(F.col("path_bytes"), root_bytes))
    listed = rows.select(
        paths.display(F.col("path_bytes")).alias("path"), "path_bytes", rel.alias("rel_path"), "size", "mtime_ns",
        "ctime_ns", "error", "kind", "changed_ns",
    )
    listed = listed.filter((F.col("kind") == DIRECTORY) | glob_rules.keeps_file(F.col("rel_path"), globs, ignore_hidden))
    return listed.dropDuplicates(["path_bytes", "changed_ns"]) if once else listed
