"""Embedding near-dedup by a bounded product of chunks.

Each distinct vector is stored once, in chunks of at most CELL_ROWS vectors and
CHUNK_BYTES. A task reads the chunks of two pieces of that table and compares
every chunk of one to every chunk of the other, so no vector is shuffled or
copied to disk for its comparisons: disk grows with the rows, only computing with
their pairs.

A pair is first bounded. Unit vectors are turned by a fixed random rotation, which
spreads their norm evenly; what the leading coordinates of a pair give to its cosine
is computed, the rest is at most the product of the remaining norms (Cauchy-Schwarz).
Both come from one matrix product in single precision, in which the remaining norm is
one more coordinate. Only pairs whose bound reaches the cosine are verified by the
exact cosine in double precision.

Equal vectors are one class. A task holds two chunks. Tasks return per class the
number of its links and one edge to its local component, never the pairs.

Defined results. A vector that is null, empty or zero, or holds a null, NaN or
infinite component, links with nothing and is a component of its own. Vectors of
different length do not link. A null id is reported as null; a component is named
by its smallest id that is not null. Repeated rows are other vectors with the same
content and link with each other. Extra columns are not read. An empty table gives
an empty result. All links are found: the join has no cap on partners.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firstseen.llm.common import components, drop, spread_join
from firstseen.workspace import setting, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COSINE = 0.9
# Most vectors and bytes of a chunk. Larger ones are read less often, the pairs of a task are compared longer.
CELL_ROWS = 32768
CHUNK_BYTES = 8 << 20
SEED = 11
_TILE = (512, 1024)
_VALUES = 1 << 21
_KEY = 16
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_FILE_ROWS = "spark.sql.files.maxRecordsPerFile"


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, key, dim, vector): key identifies the content, null if it cannot link.

    Vectors are kept in single precision where that loses nothing.
    """
    for batch in batches:
        lists = batch.column("embedding")
        starts = lists.offsets.to_numpy()
        sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(starts), 0)
        # A null component becomes NaN. One zero only.
        flat = lists.values.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False).astype("<f8", copy=False) + 0.0
        keys: list = [None] * len(sizes)
        vectors: list = [None] * len(sizes)
        for dim in np.unique(sizes[sizes > 0]).tolist():
            same = np.flatnonzero(sizes == dim)
            step = max(1, _VALUES // dim)
            for at in range(0, len(same), step):
                rows = same[at : at + step]
                x = flat[starts[rows][:, None] + np.arange(dim)]
                with np.errstate(over="ignore", invalid="ignore"):
                    narrow = x.astype("<f4")
                exact = (narrow == x).all(1)
                for k in np.flatnonzero(np.isfinite(x).all(1) & x.any(1)).tolist():
                    keys[rows[k]] = hashlib.sha256(x[k].tobytes()).digest()[:_KEY]
                    vectors[rows[k]] = (narrow[k] if exact[k] else x[k]).tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(vectors, pa.binary())],
            ["vec_id", "key", "dim", "vector"],
        )


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def leading(dim: int, cosine: float) -> int:
    """How many coordinates are multiplied for the bound: unrelated vectors must not reach the cosine."""
    return max(1, min(dim, math.ceil(dim * (4 / 3 - cosine))))


def bounding(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Leading coordinates of the turned unit vectors and the norm of the rest: products are bounds of the cosine."""
    part = x @ turn
    rest = np.sqrt(np.maximum(1 - (part * part).sum(1, keepdims=True), 0))
    return np.hstack([part, rest]).astype(np.float32)


def _packed(most: int, most_bytes: int):
    """Chunks of (key, n, dim, vector) rows, each of one length and precision."""

    def chunk(dim: int, size: int, rows: list[tuple]) -> pa.RecordBatch:
        keys, counts, vectors = zip(*rows)
        values = [dim, size > 4 * dim, b"".join(keys), np.array(counts, "<i8").tobytes(), b"".join(vectors)]
        types = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["dim", "wide", "keys", "counts", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple]] = {}
        total = 0
        for batch in batches:
            for key, n, dim, vector in zip(*(batch.column(name).to_pylist() for name in ("key", "n", "dim", "vector"))):
                kind = (dim, len(vector))
                rows = held.setdefault(kind, [])
                rows.append((key, n, vector))
                total += len(vector)
                if len(rows) >= most or len(rows) * len(vector) >= most_bytes:
                    total -= len(rows) * len(vector)
                    yield chunk(*kind, held.pop(kind))
                elif total > 8 * most_bytes:  # many lengths
                    yield from (chunk(*kind, rows) for kind, rows in held.items())
                    held, total = {}, 0
        yield from (chunk(*kind, rows) for kind, rows in held.items())

    return run


def _merge(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Union of the given pairs; labels point to the smallest index of a component."""
    while True:
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            return labels
        np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            nearer = labels[labels]
            if np.array_equal(nearer, labels):
                break
            labels = nearer


def _candidates(left: np.ndarray, right: np.ndarray, same: bool, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose bound reaches the limit; of a chunk with itself, each pair once."""
    room = np.empty(_TILE[0] * _TILE[1], np.float32)  # fresh memory for each tile is slow
    for i in range(0, len(left), _TILE[0]):
        for j in range(i if same else 0, len(right), _TILE[1]):
            a, b = left[i : i + _TILE[0]], right[j : j + _TILE[1]]
            bound = np.matmul(a, b.T, out=room[: len(a) * len(b)].reshape(len(a), len(b)))
            some = np.flatnonzero(bound.max(1) >= limit)
            if len(some):
                a, b = np.nonzero(bound[some] >= limit)
                a, b = some[a] + i, b + j
                yield (a[a < b], b[a < b]) if same else (a, b)


def _joined(cosine: float):
    def opened(row: dict, end: str, turns: dict[int, np.ndarray]) -> tuple:
        dim = row["dim"]
        if dim not in turns:
            turns[dim] = rotation(dim)[:, : leading(dim, cosine)]
        x = unit(np.frombuffer(row[f"vectors{end}"], "<f8" if row[f"wide{end}"] else "<f4").reshape(-1, dim).astype("<f8"))
        return row[f"keys{end}"], np.frombuffer(row[f"counts{end}"], "<i8"), x, bounding(x, turns[dim])

    def links_of(left: tuple, right: tuple, same: bool) -> pa.RecordBatch | None:
        (keys, n, x, part), (other_keys, other_n, y, other_part) = left, right
        dim, shift = x.shape[1], 0 if same else len(x)
        if not same:
            keys, n = keys + other_keys, np.concatenate([n, other_n])
        links, labels = np.zeros(len(n), np.int64), np.arange(len(n))
        most = max(256, _VALUES // dim)
        # Room for the rounding of single precision: a product's terms add up to 1 at most.
        limit = cosine - (dim + 16) * 2.0**-23
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def verify() -> None:
            nonlocal labels, held
            a, b = (np.concatenate(pairs) for pairs in zip(*waiting))
            waiting.clear()
            held = 0
            for k in range(0, len(a), most):
                i, j = a[k : k + most], b[k : k + most]
                ok = (x[i] * y[j]).sum(1) >= cosine
                i, j = i[ok], j[ok] + shift
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                labels = _merge(labels, i, j)

        for pairs in _candidates(part, other_part, same, limit):
            waiting.append(pairs)
            held += len(pairs[0])
            if held >= most:
                verify()
        if waiting:
            verify()
        found = np.flatnonzero(links)
        if not len(found):
            return None
        name = lambda at: pa.array([keys[k : k + _KEY] for k in (at * _KEY).tolist()], pa.binary())
        return pa.RecordBatch.from_arrays([name(found), name(labels[found]), pa.array(links[found])], ["key", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        at = left = None
        for batch in batches:
            for row in batch.to_pylist():
                if at != row["id"]:  # the rows of a chunk follow each other
                    at, left = row["id"], opened(row, "", turns)
                same = at == row["id2"]
                found = links_of(left, left if same else opened(row, "2", turns), same)
                if found is not None:
                    yield found

    return run


def meetings(chunks: DataFrame) -> DataFrame:
    """Each two chunks of one length, and each with itself, once.

    Which of two comes first goes by a hash, so that all tasks have work.
    """
    others = chunks.withColumnsRenamed({name: f"{name}2" for name in chunks.columns})
    first = F.pmod(F.xxhash64(F.least("id", "id2"), F.greatest("id", "id2")), F.lit(2)) == 0
    met = (F.col("dim") == F.col("dim2")) & ((F.col("id") == F.col("id2")) | ((F.col("id") < F.col("id2")) == first))
    return chunks.hint("shuffle_replicate_nl").join(others, met)


def linked(chunks: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(key, root, links): links of each class to others, in parts; ``root`` is linked to it.

    ``chunks`` come from ``chunked``. Planned with one row in a batch for Python.
    """
    return meetings(chunks).mapInArrow(_joined(cosine), "key binary, root binary, links long")


def chunked(classes: DataFrame) -> DataFrame:
    """``classes`` (key, n, dim, vector), one row per distinct vector, staged as numbered chunks."""
    chunks = classes.mapInArrow(_packed(CELL_ROWS, CHUNK_BYTES), "dim int, wide boolean, keys binary, counts binary, vectors binary")
    with setting(classes.sparkSession, _FILE_ROWS, "1"):
        return stage(chunks.withColumn("id", F.monotonically_increasing_id()), "vector-chunks")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select("vec_id", "embedding")
    spark = rows.sparkSession
    schema = T.StructType([
        rows.schema["vec_id"], T.StructField("key", T.BinaryType()), T.StructField("dim", T.IntegerType()), T.StructField("vector", T.BinaryType())
    ])
    prepared = stage(rows.mapInArrow(_prepared, schema), "vectors")
    members = stage(prepared.select("vec_id", "key"), "vector-members")
    able = F.col("key").isNotNull()
    chunks = chunked(
        prepared.filter(able).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    )
    drop(prepared)
    with setting(spark, _ARROW_ROWS, "1"):
        found = stage(linked(chunks, cosine), "vector-links")
    drop(chunks)
    classes = members.filter(able).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("key").agg(F.sum("links").alias("links"))
    named = stage(
        classes.join(counted, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
        .select("key", "n", "first_id", "links", F.coalesce("root", "key").alias("root")),
        "vector-facts",
    )
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    facts = stage(
        spread_join(named, smallest, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"),
        "vector-results",
    )
    linking = spread_join(members.filter(able), facts, "key").select("vec_id", "n_links", "component_id")
    alone = members.filter(~able).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linking.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
