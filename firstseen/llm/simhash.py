"""SimHash near-dedup with pigeonring filtering.

A fingerprint is cut into RING segments that stand in a ring. If two fingerprints
differ in at most t bits, then some segment starts a chain whose first l segments
differ in at most ``l * t / RING`` bits together, for every l. While that budget is
below one bit, the segments must be equal, which gives the join key: every
fingerprint is dealt out once per start, by the equal part of the chain. Within a
key the longer chains are checked with cumulative differences before the full
Hamming distance.

Equal fingerprints are one class before the join. A key shared by more than
KEY_ROWS classes is dealt out as pairs of chunks, so no task holds more than two
chunks of a key. Tasks return, for each class, the smallest class of its local
component, never the pairs, so a group of near copies costs rows in proportion
to its size.

Defined results. Null text counts as empty; a text without words has fingerprint
zero and is linked like any other. Fewer than three words make one shingle. Null
ids sort below all others and never name a component unless all its ids are null.
Rows equal in everything get equal results, in every row. Whole texts are hashed,
long ones in pieces of bounded memory. Only ``doc_id`` and ``text`` are read. An
empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firstseen.llm.common import SHARE, components, located, spread_join, stored, with_facts
from firstseen.workspace import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 64
DISTANCE = 3
RING = 16  # segments of 4 bits: five equal ones start a chain, a key of 20 bits
SEED = 42
WORDS = 3
KEY_ROWS = 8192
_PIECE = 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority of the bits of XXH64 over the word shingles of ``text``."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    hash_of = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return hash_of(b" ".join(tokens), SEED)
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    starts, ends = starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _PIECE):
        pairs = zip(starts[at : at + _PIECE], ends[at : at + _PIECE])
        hashes = np.array([hash_of(joined[a:b], SEED) for a, b in pairs], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(text) for text in batch.column("text").to_pylist()]
        signed = pa.array(np.array(values, np.uint64).view(np.int64))
        names = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in names), signed], [*names, "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, file, row, fingerprint): staged; the fingerprint as a signed long."""
    rows = located(docs, F.col("doc_id"), F.col("text"))
    out = T.StructType([field for field in rows.schema if field.name != "text"] + [T.StructField("fingerprint", T.LongType())])
    return stage(rows.mapInArrow(_fingerprints, out), "fingerprints")


def _budgets(distance: int = DISTANCE, ring: int = RING) -> list[tuple[int, int]]:
    """(segments, bits): chain lengths at which the whole-bit budget is about to grow."""
    whole = [length * distance // ring for length in range(1, ring + 1)]
    return [(length, whole[length - 1]) for length in range(1, ring + 1) if length == ring or whole[length] > whole[length - 1]]


def _rotated(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Fingerprints turned so that the chain's first segment has the lowest bits."""
    shift = (start * (BITS // RING)).astype(np.uint64)
    back = (np.uint64(BITS) - shift) % np.uint64(BITS)
    return np.where(shift == 0, values, (values >> shift) | (values << back))


def chain_keys(classes: DataFrame) -> DataFrame:
    """One row per fingerprint and start: (start, key, fingerprint)."""
    width = BITS // RING
    equal = _budgets()[0][0] * width
    turn = f"shiftrightunsigned(fingerprint, start * {width}) | shiftleft(fingerprint, {BITS} - start * {width})"
    turned = F.when(F.col("start") == 0, F.col("fingerprint")).otherwise(F.expr(turn))
    dealt = classes.select("fingerprint", F.explode(F.sequence(F.lit(0), F.lit(RING - 1))).alias("start"))
    return dealt.select("start", turned.bitwiseAND(F.lit((1 << equal) - 1)).alias("key"), "fingerprint")


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


def _near(values: np.ndarray, starts: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs pass every chain budget, the last being the full Hamming check."""
    differing = _rotated(values[left] ^ values[right], starts[left])
    width = BITS // RING
    passed = np.ones(len(left), bool)
    for length, bits in _budgets():
        mask = np.uint64(((1 << (length * width)) - 1) & 0xFFFFFFFFFFFFFFFF)
        passed[passed] = np.bitwise_count(differing[passed] & mask) <= bits
    return passed


def _group_pairs(sizes: np.ndarray, begins: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within each group of sorted rows, in pieces of about ``limit``."""
    many = sizes >= 2
    sizes, begins = sizes[many], begins[many]
    for size in np.unique(sizes):
        first, second = np.triu_indices(size, 1) if size <= 512 else (None, None)
        at = begins[sizes == size]
        if first is not None:
            step = max(1, limit // len(first))
            for i in range(0, len(at), step):
                base = at[i : i + step, None]
                yield (base + first).ravel(), (base + second).ravel()
        else:
            rows = max(1, limit // int(size))
            for begin in at:
                for i in range(0, int(size), rows):
                    a, b = np.meshgrid(np.arange(i, min(i + rows, size)), np.arange(i + 1, size), indexing="ij")
                    keep = a < b
                    yield begin + a[keep], begin + b[keep]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links found in rows sorted by (start, key, part); groups may span batches."""
    def solve(starts, keys, parts, values):
        new = np.ones(len(values), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1]) | (parts[1:] != parts[:-1])
        begins = np.flatnonzero(new)
        sizes = np.diff(np.append(begins, len(values)))
        labels = np.arange(len(values))
        for left, right in _group_pairs(sizes, begins):
            near = _near(values, starts, left, right)
            labels = _merge(labels, left[near], right[near])
        linked = np.flatnonzero(labels != np.arange(len(values)))
        return pa.RecordBatch.from_arrays(
            [pa.array(values[linked].view(np.int64)), pa.array(values[labels[linked]].view(np.int64))], ["a", "b"]
        )

    columns: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = [np.asarray(batch.column(name)) for name in ("start", "key", "part")]
        fresh.append(np.asarray(batch.column("fingerprint")).view(np.uint64))
        columns = fresh if columns is None else [np.concatenate(pair) for pair in zip(columns, fresh)]
        last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1]) & (columns[2] == columns[2][-1])
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield solve(*[column[:cut] for column in columns])
            columns = [column[cut:] for column in columns]
    if columns is not None:
        yield solve(*columns)


def _dealt(keyed: DataFrame, total: int, key_rows: int) -> DataFrame:
    """(start, key, part, fingerprint): every key with more than ``key_rows`` of ``keyed`` dealt out as pairs of chunks."""
    at = ["start", "key"]
    counts = keyed.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    chunks = F.ceil(F.col("n") / (key_rows // 2)).cast("int").alias("chunks")
    crowded = stage(counts.filter(F.col("n") > key_rows).select(*at, chunks, (F.col("n") * SHARE > total).alias("heavy")), "crowded-keys")
    # Fewer than RING * SHARE keys hold more than 1 / SHARE of the classes; the list of the others has no such bound.
    heavy = F.broadcast(crowded.filter("heavy").select(*at, "chunks"))
    others = crowded.filter("not heavy").select(*at, "chunks")
    dealt = keyed.join(heavy, at).unionByName(keyed.join(heavy.select(*at), at, "left_anti").join(others, at, "left"))
    chunk = F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int")
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    parts = dealt.withColumn("chunk", chunk).withColumn("other", other)
    pair = F.when(F.col("chunks").isNull(), 0).otherwise(
        F.least("chunk", "other") * F.col("chunks") + F.greatest("chunk", "other")
    )
    return parts.select(*at, pair.cast("long").alias("part"), "fingerprint")


def links(classes: DataFrame, total: int, key_rows: int = KEY_ROWS) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints connected by links.

    ``classes`` holds distinct fingerprints, ``total`` of them, staged.
    """
    parts = _dealt(chain_keys(classes), total, key_rows)
    sorted_parts = parts.repartition("start", "key", "part").sortWithinPartitions("start", "key", "part")
    return sorted_parts.mapInArrow(_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, file, row, fingerprint, root (longs), component_id.

    ``root`` is the fingerprint that stands for the component.
    """
    prints = fingerprints(docs)
    classes = stage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(links(classes, classes.count()))
    members = stage(roots.withColumnRenamed("node", "fingerprint").join(classes, "fingerprint"), "members")
    smallest = members.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # A root has as many members as its component has distinct fingerprints.
    linked = spread_join(members.select("fingerprint", "root"), smallest, "root")
    facts = classes.join(linked, "fingerprint", "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return spread_join(prints, stage(facts, "component-of"), "fingerprint").select(
        "doc_id", "file", "row", "fingerprint", "root", "component_id"
    )


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id."""
    docs = stored(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "file", "row")).alias("at")
    kept = near_duplicates(docs).groupBy("root").agg(first).select("at.file", "at.row")
    return with_facts(docs, kept, "left_semi")
