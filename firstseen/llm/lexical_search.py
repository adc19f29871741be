"""Ranked lexical search over impact vectors in buckets of like length.

A document is a vector with one impact per term: the term's weight times its dampened
count, whole numbers. An item asks for its terms, each as often as it has it; the
score is the inner product. Vectors hold only terms that some item has; no other
adds to a score.

The vectors are put in order of their Euclidean length and cut into buckets. With the
score an item's result must reach, by Cauchy and Schwarz a whole bucket is left out if its
longest vector is too short. In the others the largest impact of each coordinate bounds the
item's score, which leaves out more buckets, and names the few coordinates of which a
result must have one; only their lists are read. What they leave open of a vector is
bounded by the coordinates' maxima and by the length that remains. The survivors are
scored again in whole numbers. The longest vectors, SEEDS of them, are searched first; what
the items reach there is what all tasks begin with.

Items are taken in blocks of BLOCK bytes (or one item), so the vocabulary that tasks
hold has a bound; the texts are read once a block. Tasks keep the K best for each item of the block,
never scores of all pairs.

Defined results. Null texts count as empty; documents without terms are in no count
and no result, items without terms have no result. Equal scores are ranked by ``doc_id``, nulls last,
then by where the row is stored; repeated rows are ranked one by one. Repeated items, of
equal id and text, are one item; items of equal id and different text are ranked each on its own. Whole texts are read, one at a time.
Other columns are not read. Without documents or items the result is empty.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firstseen.llm.common import located
from firstseen.workspace import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 10
BLOCK = 8 << 20
SEEDS = 16_384
BUCKET_ROWS, BUCKET_ENTRIES = 2048, 4_000_000
# Terms are runs of ASCII letters and digits and of everything beyond ASCII; A-Z in lower case.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERMS).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """Of entries: the term's weight, its count and the document's number of terms."""
    m = 25 + (75 * n * documents) // words
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Items:
    """The items of a block: ``names`` (their keys), and flat terms and counts from ``starts`` on."""

    def __init__(self, rows: list[tuple[int, bytes | None]]):
        self.vocabulary: dict[bytes, int] = {}
        names, starts, terms, counts = [], [], [], []
        for name, text in rows:
            found = Counter(terms_of(text))
            if found:
                names.append(name)
                starts.append(len(terms))
                terms += [self.vocabulary.setdefault(term, len(self.vocabulary)) for term in found]
                counts += found.values()
        self.names = np.array(names, np.int64)
        self.starts, self.ends = np.array(starts, np.int64), np.array([*starts[1:], len(terms)], np.int64)
        self.terms, self.counts = np.array(terms, np.int64), np.array(counts, np.int64)
        self.lengths = np.sqrt(np.add.reduceat(self.counts.astype(float) ** 2, self.starts)) if names else np.empty(0)


def _vectors(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.vocabulary.get
        for batch in batches:
            rows, sizes, terms, counts, ends = [], [], [], [], [0]
            for i, text in enumerate(batch.column("text")):
                found = terms_of(text.as_py())
                if not found:
                    continue
                held = Counter(map(place, found))
                held.pop(None, None)
                rows.append(i)
                sizes.append(len(found))
                terms += held
                counts += held.values()
                ends.append(len(terms))
            kept = batch.select([name for name in batch.schema.names if name != "text"]).take(pa.array(rows, pa.int64()))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(values, pa.int32())) for values in (terms, counts)]
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sizes, pa.int64()), *lists], [*kept.schema.names, "n", "terms", "counts"])

    return run


def _entries(batch: pa.RecordBatch, model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, impact) of all entries of a batch."""
    weights, documents, words = model
    lists = batch.column("terms")
    sizes = np.diff(np.asarray(lists.offsets))
    rows = np.repeat(np.arange(batch.num_rows), sizes)
    terms = np.asarray(lists.flatten()).astype(np.int64)
    tf = np.asarray(batch.column("counts").flatten()).astype(np.int64)
    n = np.asarray(batch.column("n"))[rows]
    return rows, terms, impacts(weights[terms], tf, n, documents, words)


def _with_length(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, _, values = _entries(batch, shared.value)
            squares = np.bincount(rows, values.astype(float) ** 2, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.sqrt(squares))], [*batch.schema.names, "length"])

    return run


class Bucket:
    """Vectors of like length as lists by coordinate: rows and impacts from ``begin[i]`` on
    belong to ``terms[i]``, whose largest impact is ``most[i]``."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((rows, terms))
        self.rows, self.values, self.lengths = rows[order], values[order], lengths
        terms = terms[order]
        first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.empty(0, np.int64)
        self.terms, self.begin, self.end = terms[first], first, np.concatenate([first[1:], [len(terms)]]).astype(np.int64)
        self.most = np.maximum.reduceat(self.values, first) if len(first) else np.empty(0, np.int64)
        self.longest = float(lengths.max())

    def search(self, items: Items, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, rows, scores) of vectors whose score is above zero and at least the item's ``floor``."""
        at = np.minimum(np.searchsorted(self.terms, items.terms), max(len(self.terms) - 1, 0))
        held = self.terms[at] == items.terms if len(self.terms) else np.zeros(len(at), bool)
        most = np.where(held, items.counts * (self.most[at] if len(self.terms) else 0), 0)
        reach = np.add.reduceat(most, items.starts)
        far = items.lengths * self.longest * (1 + 1e-9) + 1
        for item in np.flatnonzero((far >= floor) & (reach >= floor) & (reach > 0)).tolist():
            part = np.arange(items.starts[item], items.ends[item])
            part = part[most[part] > 0]
            part = part[np.argsort(-most[part], kind="stable")]
            # left[i]: what the coordinates from i on can add. Whoever has none before `focus` stays below the floor.
            left = np.concatenate([np.cumsum(most[part][::-1])[::-1], [0]])
            focus = int(np.argmax(left < max(floor[item], 1)))
            lists = at[part]
            times = items.counts[part]
            spans = [slice(a, b) for a, b in zip(self.begin[lists].tolist(), self.end[lists].tolist())]
            scores = np.zeros(len(self.lengths), np.int64)
            seen = np.zeros(len(self.lengths))
            for span, k in zip(spans[:focus], times.tolist()):
                scores[self.rows[span]] += k * self.values[span]
                seen[self.rows[span]] += self.values[span].astype(float) ** 2
            rows = np.flatnonzero(scores)
            if focus < len(part) and len(rows):
                rest = math.sqrt(float((times[focus:].astype(float) ** 2).sum()))
                open_length = np.sqrt(np.maximum(self.lengths[rows] ** 2 * (1 + 1e-9) - seen[rows], 0))
                bound = np.minimum(rest * open_length * (1 + 1e-9) + 1, left[focus])
                rows = rows[scores[rows] + bound >= floor[item]]
                for span, k in zip(spans[focus:], times[focus:].tolist()):
                    there = self.rows[span]
                    where = np.minimum(np.searchsorted(there, rows), len(there) - 1)
                    scores[rows] += np.where(there[where] == rows, k * self.values[span][where], 0)
            rows = rows[scores[rows] >= max(floor[item], 1)]
            if len(rows):
                yield item, rows, scores[rows]


def _search(shared_items, shared_model, shared_floor, k: int):
    """The ``k`` best vectors of a task for each item; vectors come longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floor = shared_items.value, shared_floor.value.copy()
        best: dict[int, list[tuple]] = {}

        def take(batch: pa.RecordBatch) -> None:
            bucket = Bucket(*_entries(batch, shared_model.value), np.asarray(batch.column("length")))
            ids, files, places = (batch.column(name) for name in ("doc_id", "file", "row"))
            for item, rows, scores in bucket.search(items, floor):
                if len(rows) > k:
                    # Whoever ties with the last place may still come before it by id.
                    near = scores >= np.partition(scores, -k)[-k]
                    rows, scores = rows[near], scores[near]
                at = pa.array(rows, pa.int64())
                found = zip((-scores).tolist(), ids.take(at).to_pylist(), files.take(at).to_pylist(), places.take(at).to_pylist())
                merged = [(score, i is None, i if i is not None else 0, file, row) for score, i, file, row in found]
                best[item] = sorted(best.get(item, []) + merged)[:k]
                if len(best[item]) == k:
                    floor[item] = max(floor[item], -best[item][-1][0])

        for batch in batches:
            ends = np.asarray(batch.column("terms").offsets)
            begin = 0
            while begin < batch.num_rows:
                full = int(np.searchsorted(ends, ends[begin] + BUCKET_ENTRIES, "right")) - 1
                rows = max(1, min(BUCKET_ROWS, full - begin, batch.num_rows - begin))
                # Copied, so that the offsets of its lists begin at zero.
                take(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(begin, rows)]) if not pa.types.is_list(c.type) else
                     pa.ListArray.from_arrays(pa.array(ends[begin : begin + rows + 1] - ends[begin], pa.int32()), c.values.slice(ends[begin], ends[begin + rows] - ends[begin]))
                     for c in batch.columns], batch.schema.names))
                begin += rows
        out = [(int(items.names[item]), *row) for item, rows in best.items() for row in rows]
        columns = list(zip(*out)) or [[]] * 6
        ids = [None if none else i for none, i in zip(columns[2], columns[3])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array([-s for s in columns[1]], pa.int64()), pa.array(ids, id_type),
             pa.array(columns[4], pa.string()), pa.array(columns[5], pa.int64())],
            ["item", "score", "doc_id", "file", "row"],
        )

    id_type = pa.int64()
    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each item: first among a sixteenth of its rows, then of all."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "file", "row"]
    part = F.pmod(F.xxhash64("file", "row"), F.lit(16))
    cut = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order)))
    cut = cut.filter(F.col("rank") <= k)
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k).drop("part")


def _search_block(docs: DataFrame, rows: DataFrame, k: int) -> DataFrame | None:
    """(item, score, doc_id, file, row, rank) for the items of a block, or nothing without terms or documents."""
    spark = docs.sparkSession
    items = Items([(r["item"], r["text"]) for r in rows.orderBy("item").toLocalIterator()])
    if not items.vocabulary:
        return None
    shared = spark.sparkContext.broadcast(items)
    texts = located(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, file string, row long, n long, terms array<int>, counts array<int>"
    vectors = stage(texts.mapInArrow(_vectors(shared), schema), "term-vectors")
    totals = vectors.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("words")).first()
    if not totals["documents"]:
        return None
    holding = dict(map(tuple, vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()))
    weights = np.array([weight(totals["documents"], holding.get(t, 0)) for t in range(len(items.vocabulary))], np.int64)
    model = spark.sparkContext.broadcast((weights, totals["documents"], totals["words"]))
    measured = vectors.filter(F.size("terms") > 0).mapInArrow(_with_length(model), f"{schema}, length double")
    by_length = stage(measured.repartitionByRange(F.desc("length")).sortWithinPartitions(F.desc("length")), "vectors-by-length")
    share = max(0.0, 1 - SEEDS / totals["documents"])
    cut = by_length.agg(F.percentile_approx("length", F.lit(share))).first()[0]
    out = "item long, score long, doc_id long, file string, row long"

    def best(part: DataFrame, floor: np.ndarray, label: str) -> DataFrame:
        # Files are read in pieces, each in order of length.
        found = part.mapInArrow(_search(shared, model, spark.sparkContext.broadcast(floor), k), out)
        return stage(_ranked(found, k), label)

    floor = np.ones(len(items.names), np.int64)
    longest = best(by_length.filter(F.col("length") >= cut), floor, "best-of-longest")
    place = {name: i for i, name in enumerate(items.names.tolist())}
    for r in longest.filter(F.col("rank") == k).select("item", "score").collect():  # a row for each item of the block
        floor[place[r["item"]]] = r["score"]
    others = best(by_length.filter(F.col("length") < cut), floor, "best-of-others")
    return stage(_ranked(longest.unionByName(others).drop("rank"), k), "best")


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score, file, row): the ``k`` best rows of ``docs`` (doc_id, a whole number, and text)
    for each row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    asked = items.select("item_id", F.col("text").cast("binary").alias("text")).distinct()
    asked = stage(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    blocks, spread = 1, lambda: F.pmod(F.xxhash64("item"), F.lit(blocks))
    while True:
        sized = asked.groupBy(spread().alias("b")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n"))
        most = sized.filter("n > 1").agg(F.max("bytes")).first()[0]
        if (most or 0) <= block:
            break
        blocks *= 2
    found = [_search_block(docs, asked.filter(spread() == b), k) for b in range(blocks)]
    empty = spark.createDataFrame([], "item long, score long, doc_id long, file string, row long, rank int")
    for part in found:
        empty = empty.unionByName(part) if part is not None else empty
    return empty.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score", "file", "row")
