"""Work on file contents: digests, existence checks and copies.

Payloads never pass through Spark. Tasks open the files themselves, read them in
chunks and return digests and statuses, so a file may be larger than a row can
be. Every task overlaps its I/O with a few threads.
"""

from __future__ import annotations

import errno
import fcntl
import hashlib
import os
import shutil
import uuid
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK_BYTES = 4 << 20
THREADS = 4
TASK_BYTES = 2 << 30
TASK_FILES = 20_000
# Files a task hands to its threads at once.
_AT_ONCE = 1_000

# Fixed value: request number of the Linux "clone file range" ioctl.
_FICLONE = 0x40049409


def spread_by_bytes(rows: DataFrame, key: str, files: int, total_bytes: int) -> DataFrame:
    """Partition file work by a uniform key, sized by bytes and by file count."""
    slots = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(files, 4 * slots), -(-total_bytes // TASK_BYTES), -(-files // TASK_FILES), 1)
    return rows.repartition(int(tasks), key)


def _digest(path: bytes, chunk_bytes: int) -> bytes:
    digest = hashlib.sha256()
    buffer = memoryview(bytearray(chunk_bytes))
    with open(path, "rb", buffering=0) as source:
        while size := source.readinto(buffer):
            digest.update(buffer[:size])
    return digest.digest()


def _appender(out_columns: list[tuple[str, pa.DataType]], work, inputs: list[str], threads: int):
    """mapInArrow function that appends ``work(*inputs)`` to every row."""

    def run(batches):
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                for begin in range(0, batch.num_rows, _AT_ONCE):
                    part = batch.slice(begin, _AT_ONCE)
                    arguments = [part.column(part.schema.get_field_index(name)).to_pylist() for name in inputs]
                    results = list(pool.map(work, *arguments))
                    arrays, names = list(part.columns), list(part.schema.names)
                    for index, (name, kind) in enumerate(out_columns):
                        arrays.append(pa.array([row[index] for row in results], type=kind))
                        names.append(name)
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _extended(rows: DataFrame, *added: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType(rows.schema.fields + [T.StructField(name, kind) for name, kind in added])


def hash_files(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES, threads: int = THREADS) -> DataFrame:
    """Append ``content_hash`` and ``hash_error`` for the files in ``path_bytes``."""

    def work(path):
        try:
            return _digest(path, chunk_bytes), None
        except OSError as problem:
            return None, str(problem)

    schema = _extended(rows, ("content_hash", T.BinaryType()), ("hash_error", T.StringType()))
    columns = [("content_hash", pa.binary()), ("hash_error", pa.string())]
    return rows.mapInArrow(_appender(columns, work, ["path_bytes"], threads), schema)


def probe(rows: DataFrame, column: str, threads: int = THREADS) -> DataFrame:
    """Append ``present`` and ``probe_error`` for the paths in a BINARY column.

    A check that fails for another reason than absence reports the error and
    leaves ``present`` NULL, so that the caller can keep the row.
    """

    def work(path):
        if path is None:
            return None, None
        try:
            os.stat(path)
            return True, None
        except (FileNotFoundError, NotADirectoryError):
            return False, None
        except OSError as problem:
            return None, str(problem)

    schema = _extended(rows, ("present", T.BooleanType()), ("probe_error", T.StringType()))
    columns = [("present", pa.bool_()), ("probe_error", pa.string())]
    return rows.mapInArrow(_appender(columns, work, [column], threads), schema)


def _fill(source: bytes, temp: bytes, how: str) -> None:
    """Put the source's bytes at ``temp``; a clone falls back to a byte copy."""
    if how == "reflink":
        try:
            with open(source, "rb") as src, open(temp, "wb") as dst:
                fcntl.ioctl(dst.fileno(), _FICLONE, src.fileno())
            shutil.copymode(source, temp)
            return
        except OSError:
            pass
    shutil.copyfile(source, temp)
    shutil.copymode(source, temp)


def _publish(temp: bytes, target: bytes) -> None:
    """Make ``temp`` visible as ``target`` unless the target exists."""
    try:
        os.link(temp, target)
    except OSError as problem:
        if problem.errno not in (errno.EPERM, errno.ENOTSUP, errno.EMLINK):
            raise
        # A filesystem without links: check and rename.
        if os.path.lexists(target):
            raise FileExistsError("destination already exists") from problem
        os.rename(temp, target)


def _place(source: bytes, target: bytes, digest: bytes, override: bool, how: str, chunk_bytes: int) -> None:
    parent = os.path.dirname(target)
    os.makedirs(parent, exist_ok=True)
    if not override and os.path.lexists(target):
        # A retried task finds the file its first attempt placed.
        if os.path.isfile(target) and _digest(target, chunk_bytes) == digest:
            return
        raise FileExistsError("destination already exists")
    temp = os.path.join(parent, b".firstseen_tmp_" + uuid.uuid4().hex.encode())
    try:
        if how == "hard-link":
            os.link(source, temp)
        else:
            _fill(source, temp, how)
        if override:
            os.replace(temp, target)
        else:
            _publish(temp, target)
    finally:
        if os.path.lexists(temp):
            os.unlink(temp)


def _check_mode(how: str) -> None:
    if how not in ("reflink", "copy", "hard-link"):
        raise ValueError(f"unknown copy mode {how!r}")


def copy_files(
    rows: DataFrame,
    override: bool = False,
    how: str = "reflink",
    chunk_bytes: int = CHUNK_BYTES,
    threads: int = THREADS,
) -> DataFrame:
    """Copy ``path_bytes`` to ``dest_bytes``; append ``copy_error`` (NULL = done).

    Parents are created, the data goes to a hidden temporary name in the target
    directory and becomes visible by one atomic step. Without ``override`` that
    step is a link, which fails if the target appeared meanwhile. A target that
    already has this row's digest counts as done, so a retried task is harmless.
    """
    _check_mode(how)

    def work(source, target, digest):
        try:
            _place(source, target, digest, override, how, chunk_bytes)
            return (None,)
        except OSError as problem:
            return (str(problem),)

    schema = _extended(rows, ("copy_error", T.StringType()))
    inputs = ["path_bytes", "dest_bytes", "content_hash"]
    return rows.mapInArrow(_appender([("copy_error", pa.string())], work, inputs, threads), schema)


def copy_in_turn(
    rows: DataFrame, override: bool = False, how: str = "reflink", chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Copy the first file of each content that can be copied; append ``copy_error``.

    Rows are sorted by content and path order within their partition and each
    content lies in one partition. The files of a content are tried one after
    the other; those after the first good copy are not returned.
    """
    _check_mode(how)

    def run(batches):
        placed = None
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
            keep, errors = [], []
            for source, target, digest in zip(column("path_bytes"), column("dest_bytes"), column("content_hash")):
                keep.append(digest != placed)
                if digest == placed:
                    continue
                try:
                    _place(source, target, digest, override, how, chunk_bytes)
                    errors.append(None)
                    placed = digest
                except OSError as problem:
                    errors.append(str(problem))
            tried = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [*tried.columns, pa.array(errors, pa.string())], names=[*tried.schema.names, "copy_error"]
            )

    return rows.mapInArrow(run, _extended(rows, ("copy_error", T.StringType())))
