"""Substring dedup by difference-cover anchors.

A window is WINDOW consecutive words of a document. A window goes if the same words
also start earlier: in a document that comes first, or at an earlier place of the
same one. Every word that such a window covers is removed; windows are judged on the
input, not on what is left.

COVER is a difference cover of PERIOD: for any two places there is an offset below
PERIOD that takes both to places whose remainder is in COVER. So only the runs of
``WINDOW - PERIOD + 1`` words at those places are hashed, four of thirteen, and two
equal windows always hold an equal run at the same offset, their anchor. Runs are counted,
combining before the shuffle; only where one recurs is it extended, to all windows
around it. Those are told apart by a 128-bit hash of their words, whose first
document is a minimum by hash; in a document only the first of equal windows takes part. Windows are
compared in PARTS parts by hash, one after the other, so that shuffles hold only a part of them at a time.

The texts move twice, to meet their recurring anchors and to lose their words;
everything else is hashes and places. An anchor or window with more than 1 / SHARE of the
rows meets its fact by broadcast, all others by a shuffle, so no passage that very many
documents share gathers in one task.

Defined results. Null text counts as empty and has no words. Documents come in the
order of ``doc_id``, nulls last, rows of one id in the order of where they are stored;
so the first of repeated rows stays and the others lose every word that a window
covers. A text of fewer than WINDOW words loses nothing. Whole texts are read; a task's
memory is bounded by its longest text, whose anchors and windows leave it in pieces.
Columns other than ``doc_id`` and ``text`` are neither read nor lost. An empty table gives an empty result.
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

from firstseen.llm.common import SHARE, drop, located, stored, with_facts
from firstseen.workspace import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 20
# A perfect difference set, and its modulus.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
PARTS = 4
_PIECE = 1 << 16
_SPACE = 0x20


class Words:
    """The words of a text as one run of bytes, joined by single spaces."""

    def __init__(self, text: bytes | None):
        self.joined = b" ".join((text or b"").split())
        gaps = np.flatnonzero(np.frombuffer(self.joined, np.uint8) == _SPACE)
        some = [0] if self.joined else []
        self.starts = np.concatenate([some, gaps + 1]).astype(np.int64)
        self.ends = np.concatenate([gaps, [len(self.joined)] if some else []]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def runs(self, at: np.ndarray, length: int) -> Iterator[bytes]:
        joined = self.joined
        return (joined[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at + length - 1].tolist()))


def cover_places(begin: int, end: int) -> np.ndarray:
    """Places from the anchor numbered ``begin`` up to ``end``: number k stands in turn k div |COVER|."""
    turn, which = np.divmod(np.arange(begin, end), len(COVER))
    return turn * PERIOD + np.array(COVER)[which]


def n_anchors(words: int) -> int:
    """How many anchors a text of so many words has: those that fit, if a window fits."""
    if words < WINDOW:
        return 0
    turn, left = divmod(words - ANCHOR + 1, PERIOD)
    return turn * len(COVER) + sum(place < left for place in COVER)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece of a text: the number of its first anchor, and the anchors' hashes."""
    hash_of = xxhash.xxh3_64_intdigest
    for batch in batches:
        rows, firsts, ends, hashes = [], [], [0], []
        for i, text in enumerate(batch.column("text")):
            words = Words(text.as_py())
            total = n_anchors(len(words))
            for first in range(0, total, _PIECE):
                at = cover_places(first, min(first + _PIECE, total))
                hashes.append(np.fromiter(map(hash_of, words.runs(at, ANCHOR)), np.uint64, len(at)))
                rows.append(i)
                firsts.append(first)
                ends.append(ends[-1] + len(at))
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        kept = batch.select([name for name in batch.schema.names if name != "text"]).take(pa.array(rows, pa.int64()))
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(firsts, pa.int32()), listed], [*kept.schema.names, "first", "hashes"]
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows around recurring anchors, per part of the hashes and piece of a text. Those
    whose window stands earlier in the text are in part -1; the others come with their hash."""
    hash_of = xxhash.xxh3_128_digest
    out: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        ends = pa.array(np.cumsum([0, *(len(row[2]) for row in out)]), pa.int32())
        starts = np.concatenate([row[2] for row in out]) if out else np.empty(0, np.int64)
        halves = np.concatenate([row[3] for row in out]) if out else np.empty((0, 2), np.int64)
        lists = [pa.array(starts.astype(np.int32)), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
        columns = [pa.array([row[0] for row in out], pa.int64()), pa.array([row[1] for row in out], pa.int32())]
        columns += [pa.ListArray.from_arrays(ends, values) for values in lists]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["order", "part", "starts", "high", "low"])

    held = 0
    for batch in batches:
        for text, order, met in zip(batch.column("text"), batch.column("__order").to_pylist(), batch.column("__met")):
            words = Words(text.as_py())
            last = len(words) - WINDOW
            marks = np.zeros(last + PERIOD + 2, np.int64)
            numbers = np.asarray(met.values)
            marks[cover_places(0, int(numbers.max()) + 1)[numbers] + 1] = 1
            marks = marks.cumsum()
            at = np.flatnonzero(marks[PERIOD : last + PERIOD + 1] > marks[: last + 1])
            seen: set[bytes] = set()
            for begin in range(0, len(at), _PIECE):
                piece = at[begin : begin + _PIECE]
                hashes = [*map(hash_of, words.runs(piece, WINDOW))]
                fresh = np.ones(len(piece), bool)
                for i, value in enumerate(hashes):
                    if value in seen:
                        fresh[i] = False
                    seen.add(value)
                halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                part = np.where(fresh, halves[:, 0] % PARTS, -1)
                out += [(order, k, piece[part == k], halves[part == k]) for k in range(-1, PARTS) if (part == k).any()]
                held += len(piece)
                if held >= _PIECE:
                    yield flush()
                    held = 0
    yield flush()


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        totals, removed, texts = [], [], []
        for text, gone in zip(batch.column("text"), batch.column("__gone")):
            words = Words(text.as_py())
            totals.append(len(words))
            if not gone.is_valid:
                removed.append(0)
                texts.append(words.joined)
                continue
            change = np.zeros(len(words) + 1, np.int64)
            starts = np.asarray(gone.values)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + WINDOW, -1)
            keep = np.flatnonzero(change.cumsum()[:-1] == 0)
            removed.append(len(words) - len(keep))
            texts.append(b" ".join(words.runs(keep, 1)))
        names = [name for name in batch.schema.names if name not in ("text", "__gone")]
        facts = [pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary())]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *facts], [*names, "__words", "__removed", "__kept"])


def _meet(rows: DataFrame, facts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` joined to ``facts``, staged, whose ``n`` is how many of the ``total`` rows have its key."""
    heavy = F.broadcast(facts.filter(F.col("n") * SHARE > total))
    hot = rows.join(heavy, keys)
    cold = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(facts.filter(F.col("n") * SHARE <= total), keys)
    return hot.unionByName(cold)


def repeats(docs: DataFrame) -> DataFrame:
    """(file, row, starts): where the windows that go start, for each document (from ``stored``) with any."""
    rows = located(docs, "doc_id", F.col("text").cast("binary").alias("text"))
    out = T.StructType([field for field in rows.schema if field.name != "text"] + [
        T.StructField("first", T.IntegerType()), T.StructField("hashes", T.ArrayType(T.LongType()))])
    anchors = stage(rows.mapInArrow(_anchors, out).withColumn("piece", F.monotonically_increasing_id()), "anchors")
    each = anchors.select("piece", F.posexplode("hashes").alias("k", "hash"))
    counts = each.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    total = anchors.agg(F.sum(F.size("hashes"))).first()[0] or 0
    recurring = stage(counts, "recurring-anchors")
    met = _meet(each, recurring, ["hash"], total)
    met = met.groupBy("piece").agg(F.collect_list("k").alias("ks"))
    places = anchors.select("piece", "doc_id", "file", "row", "first").join(met, "piece")
    shifted = F.transform("ks", lambda k: k + F.col("first"))
    of_row = places.groupBy("doc_id", "file", "row").agg(F.flatten(F.collect_list(shifted)).alias("__met"))
    # Ids by position in the order of documents: rows sorted by range, numbered where they lie.
    by = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("file"), F.col("row")]
    ordered = of_row.repartitionByRange(*by).sortWithinPartitions(*by)
    ordered = stage(ordered.withColumn("__order", F.monotonically_increasing_id()), "documents-in-order")
    texts = with_facts(docs.select(F.col("text").cast("binary").alias("text"), "_metadata"), ordered.drop("doc_id"), "inner")
    schema = "order long, part int, starts array<int>, high array<long>, low array<long>"
    windows = stage(texts.select("text", "__order", "__met").mapInArrow(_windows, schema), "windows")
    drop(anchors, recurring)
    gone = windows.filter("part = -1").select("order", F.explode("starts").alias("start"))
    for part in range(PARTS):
        mine = windows.filter(F.col("part") == part)
        each = mine.select("order", F.inline(F.arrays_zip("starts", "high", "low")).alias("start", "high", "low"))
        counts = each.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.min("order").alias("first"))
        facts = stage(counts.filter("n > 1"), "recurring-windows")
        total = mine.agg(F.sum(F.size("starts"))).first()[0] or 0
        later = _meet(each, facts, ["high", "low"], total).filter("order > first").select("order", "start")
        gone = gone.union(stage(later, "later-windows"))
        drop(facts)
    gone = gone.groupBy("order").agg(F.collect_list("start").alias("starts"))
    found = ordered.select(F.col("__order").alias("order"), "file", "row").join(gone, "order").select("file", "row", "starts")
    found = stage(found, "removed-windows")
    drop(windows, ordered)
    return found


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cut to the words kept, joined by one space, and two more
    columns: ``__words`` and ``__removed``, the number of words before and of those removed."""
    docs = stored(docs)
    facts = repeats(docs).withColumnRenamed("starts", "__gone")
    rows = with_facts(docs, facts, "left").withColumn("text", F.col("text").cast("binary"))
    fields = [field for field in rows.schema if field.name not in ("text", "__gone")]
    out = T.StructType(fields + [
        T.StructField("__words", T.LongType()), T.StructField("__removed", T.LongType()), T.StructField("__kept", T.BinaryType())])
    kept = rows.mapInArrow(_kept, out).withColumn("__kept", F.col("__kept").cast("string"))
    return kept.select(*(F.col("__kept" if c == "text" else c).alias(c) for c in docs.columns), "__words", "__removed")
