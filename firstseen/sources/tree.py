"""Recursive scan of a source tree into a manifest.

The tree is listed by Spark jobs over a frontier of directories. A task walks
its directory depth first until it has seen a budgeted number of entries, then
hands the directories it has not opened to the next round. Small trees finish in
one round; a subtree that holds a third of all files is cut into as many work
items as it needs. Names and metadata are read in two stages, so the files of a
single huge directory are also stat-ed by many tasks.

The built-in file sources are not used because they drop hidden and empty files
and truncate modification times to milliseconds.
"""

from __future__ import annotations

import ctypes
import os
import stat
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firstseen import schemas
from firstseen.functions import globs as glob_rules
from firstseen.functions import paths
from firstseen.workspace import fresh_folder

# Entries one work item lists before it passes its open directories on.
LIST_BUDGET = 20_000
_BATCH = 5_000

FILE, DIRECTORY, PENDING = "file", "dir", "pending"


@dataclass
class Listing:
    """``files`` is a MANIFEST; ``directories`` has path_bytes and error."""

    root: str
    files: DataFrame
    directories: DataFrame


def _spread(df: DataFrame, rows: int, per_task: int, *keys: str) -> DataFrame:
    """Hash-partition work items so that each task gets about ``per_task``."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(rows, 4 * slots), -(-rows // per_task), 1)
    return df.repartition(tasks, *keys)


def _list_task(root: bytes, pruned, budget: int):
    """Listing function for mapInArrow over (path_bytes)."""
    prefix = len(root.rstrip(b"/")) + 1
    schema = pa.schema([("path_bytes", pa.binary()), ("kind", pa.string()), ("error", pa.string())])

    def walk(start: bytes) -> Iterator[tuple[bytes, str, str | None]]:
        stack, seen = [start], 0
        while stack:
            if seen >= budget:
                yield from ((directory, PENDING, None) for directory in stack)
                return
            directory = stack.pop()
            try:
                with os.scandir(directory) as entries:
                    for entry in entries:
                        seen += 1
                        if entry.is_file(follow_symlinks=False):
                            yield entry.path, FILE, None
                        elif entry.is_dir(follow_symlinks=False):
                            if not pruned(entry.path[prefix:].decode("utf-8", "replace")):
                                stack.append(entry.path)
            except OSError as problem:
                yield directory, DIRECTORY, str(problem)
            else:
                yield directory, DIRECTORY, None

    def run(batches):
        rows = []
        for batch in batches:
            for directory in batch.column(0).to_pylist():
                for row in walk(directory):
                    rows.append(row)
                    if len(rows) >= _BATCH:
                        yield _batch(rows, schema)
                        rows = []
        if rows:
            yield _batch(rows, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(column, type=field.type) for column, field in zip(columns, schema)], schema=schema
    )


def _birth_time_reader():
    """Function path -> creation time in ns, 0 where the platform has none."""
    # Fixed values of the Linux statx call: arguments, and in its 256-byte
    # result the offsets of the field mask and of the creation time.
    at_fdcwd, want_birth, result_bytes = -100, 0x800, 256
    mask_at, birth_at = 0, 80
    statx = getattr(ctypes.CDLL(None), "statx", None)

    def read(path: bytes) -> int:
        result = ctypes.create_string_buffer(result_bytes)
        if statx is None or statx(at_fdcwd, path, 0, want_birth, result) != 0:
            return 0
        if not struct.unpack_from("=I", result, mask_at)[0] & want_birth:
            return 0
        seconds, nanos = struct.unpack_from("=qI", result, birth_at)
        return seconds * 1_000_000_000 + nanos

    return read


def described(path: bytes, info: os.stat_result, birth_time) -> tuple[int | None, int | None, int | None, str | None]:
    """(size, mtime_ns, ctime_ns, error) of a file."""
    born = birth_time(path)
    problem = None
    if not stat.S_ISREG(info.st_mode):
        problem = "not a regular file any more"
    elif info.st_mtime_ns < 0 or born < 0:
        problem = "file time is before 1970"
    elif info.st_mtime_ns >= 1 << 63:
        problem = "file time does not fit nanoseconds in 64 bits"
    return (None, None, None, problem) if problem else (info.st_size, info.st_mtime_ns, born, None)


def _stat_task(batches):
    """(path_bytes) -> (path_bytes, size, mtime_ns, ctime_ns, error)."""
    schema = pa.schema([
        ("path_bytes", pa.binary()), ("size", pa.int64()), ("mtime_ns", pa.int64()),
        ("ctime_ns", pa.int64()), ("error", pa.string()),
    ])
    birth_time = _birth_time_reader()
    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            try:
                rows.append((path, *described(path, os.stat(path), birth_time)))
            except OSError as problem:
                rows.append((path, None, None, None, str(problem)))
        if rows:
            yield _batch(rows, schema)


def scan_tree(
    spark: SparkSession,
    source: str,
    globs: Sequence[str] = (),
    ignore_hidden: bool = False,
    budget: int = LIST_BUDGET,
) -> Listing:
    """List ``source`` and read the metadata of every file the rules keep.

    The driver sees one count per round, never a path. Links are not followed.
    A file that vanishes or cannot be read keeps its row, with ``error`` set.
    """
    parsed = glob_rules.parse_globs(globs)
    root = os.path.realpath(source)
    root_bytes = os.fsencode(root)
    os.stat(root_bytes)
    display_root = root_bytes.decode("utf-8", "replace")

    if os.path.isfile(root):
        names = spark.createDataFrame([(bytearray(root_bytes),)], "path_bytes binary")
        directories = spark.createDataFrame([], "path_bytes binary, error string")
        return Listing(display_root, _with_metadata(names, 1, root_bytes, display_root), directories)

    pruned = glob_rules.dir_pruner(parsed, ignore_hidden)
    task = _list_task(root_bytes, pruned, budget)
    folder = fresh_folder(spark, "listing")
    frontier = spark.createDataFrame([(bytearray(root_bytes),)], "path_bytes binary")
    waiting, rounds = 1, 0
    while waiting:
        listed = _spread(frontier, waiting, 64, "path_bytes").mapInArrow(task, schemas.LISTING)
        listed.write.partitionBy("kind").parquet(f"{folder}/round={rounds}")
        level = spark.read.schema(schemas.LISTING).parquet(f"{folder}/round={rounds}")
        frontier = level.filter(F.col("kind") == PENDING).select("path_bytes")
        waiting = frontier.count()
        rounds += 1

    everything = spark.read.schema(schemas.LISTING).parquet(folder)
    names = everything.filter(F.col("kind") == FILE).select("path_bytes")
    rel = paths.relative_path(paths.display(F.col("path_bytes")), display_root)
    names = names.filter(glob_rules.keeps_file(rel, globs, ignore_hidden))
    directories = everything.filter(F.col("kind") == DIRECTORY).select("path_bytes", "error")
    return Listing(display_root, _with_metadata(names, names.count(), root_bytes, display_root), directories)


def _with_metadata(names: DataFrame, rows: int, root: bytes, display_root: str) -> DataFrame:
    facts = _spread(names, rows, 20_000, "path_bytes").mapInArrow(
        _stat_task, "path_bytes binary, size bigint, mtime_ns bigint, ctime_ns bigint, error string"
    )
    path = paths.display(F.col("path_bytes"))
    rel = paths.display(paths.relative_bytes(F.col("path_bytes"), root))
    return facts.select(
        path.alias("path"), "path_bytes", rel.alias("rel_path"), "size", "mtime_ns", "ctime_ns", "error"
    )
