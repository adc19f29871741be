"""Quality classifier: supervised subword embeddings, trained by numpy SGD.

A document is the average of learned vectors, one per occurrence of a word, of a
pair of neighbouring words and of their character n-grams, all hashed into one
table of fixed size; a softmax over the labels is put on the average. Words are
runs of bytes other than white space, between two marks, so that n-grams know
word ends. N-grams are taken from the words' UTF-8 bytes, so hashing a text is a
few vector operations per length.

Training fits on at most SAMPLE labelled documents, those with the smallest hash
of their id among the ids that have a document, each of whole text; the bound is a
parameter. Of the rows with one id and label, the one stored first is taken. Their feature counts
are made in tasks and go to one more, at most FEATURES pairs of each. That task trains, since every
step needs the one before; the driver gets the model alone. Scoring needs only one number per bucket, the difference of the two
classes' logits, since averages are linear.

Defined results. A null or blank text has no features and gets the score of the
bias. Null labels and ids are not learned from; null ids are scored. If no
labelled document is given, all scores are the prior 0.5; with one class only,
they tend to it. Repeated rows get equal scores. Memory is bounded by a batch of
texts. Only the named columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firstseen.llm.common import located, stored
from firstseen.workspace import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 4_000
FEATURES = 1 << 14  # buckets, and so the most features of a sampled document
LENGTHS = (1, 2, 3, 4)
DIMENSION = 8
EPOCHS = 12
LEAST_STEPS = 24_000
RATE = 0.4
SEED = 7
_PIECE = 1 << 20
# Odd multipliers of the rolling hashes.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _buckets(values: np.ndarray, kind: int, buckets: int) -> np.ndarray:
    mixed = (values + np.uint64(kind + 1)) * _MIX
    return ((mixed ^ (mixed >> np.uint64(29))) * _STEP >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)


def features(raw: np.ndarray, buckets: int = FEATURES) -> np.ndarray:
    """Buckets of all words and n-grams of one text's bytes."""
    if not len(raw):
        return np.zeros(0, np.int64)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    marked = np.where(blank, np.uint8(32), raw)
    marked = np.concatenate([[np.uint8(32)], marked, [np.uint8(32)]]).astype(np.uint64)
    blank = marked == 32
    out = []
    gram = np.zeros(len(marked), np.uint64)
    inner = np.zeros(len(marked), np.int64)  # blanks strictly inside the n-gram
    for length in range(1, max(LENGTHS) + 1):
        size = len(marked) - length + 1
        if size <= 0:
            break
        gram = gram[:size] * np.uint64(257) + marked[length - 1 :] + np.uint64(1)
        if length >= 3:
            inner = inner[:size] + blank[length - 2 : length - 2 + size]
        if length in LENGTHS:
            whole = ~blank if length == 1 else ~(blank[:size] & blank[length - 1 :]) & (inner[:size] == 0)
            out.append(_buckets(gram[whole], length, buckets))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    begins, ends = edges[::2] + 1, edges[1::2] + 1
    if len(begins):
        # A word's hash is a sum over its bytes, each weighed by its place in the word.
        place = np.arange(len(marked)) - np.repeat(np.append(0, begins), np.diff(np.concatenate([[0], begins, [len(marked)]])))
        weight = (place.astype(np.uint64) + np.uint64(1)) * _STEP
        weight = (weight ^ (weight >> np.uint64(31))) * _MIX
        sums = np.concatenate([[np.uint64(0)], np.cumsum((marked + np.uint64(1)) * weight, dtype=np.uint64)])
        words = sums[ends] - sums[begins]
        out.append(_buckets(words, 0, buckets))
        # Word pairs by the difference of their hashes: all immediate repeats are one feature.
        out.append(_buckets(words[1:] - words[:-1], max(LENGTHS) + 1, buckets))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A long text cut at blanks, so that no n-gram or word is cut."""
    begin = 0
    while len(raw) - begin > 2 * _PIECE:
        window = raw[begin + _PIECE : begin + 2 * _PIECE]
        blank = np.flatnonzero((window == 32) | (window == 10))
        end = begin + _PIECE + (int(blank[0]) if len(blank) else _PIECE)
        yield raw[begin:end]
        begin = end
    yield raw[begin:]


def counts(raw: np.ndarray, buckets: int = FEATURES) -> np.ndarray:
    total = np.zeros(buckets, np.int64)
    for piece in _pieces(raw):
        total += np.bincount(features(piece, buckets), minlength=buckets)
    return total


def _bytes_of(text) -> np.ndarray:
    buffer = text.as_buffer() if text.is_valid else None
    return np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in batch.column("text"):
            n = counts(_bytes_of(text))
            at = np.flatnonzero(n)
            found.append((at.astype("<i4").tobytes(), n[at].astype("<f4").tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())],
            ["label", "buckets", "counts"],
        )


class Model:
    """``weights``: logit of label 1 over label 0, per bucket; ``bias``."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, raw: np.ndarray) -> float:
        total, n = 0.0, 0
        for piece in _pieces(raw):
            at = features(piece, len(self.weights))
            total, n = total + float(self.weights[at].sum()), n + len(at)
        logit = self.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))


class Sample:
    """(label, buckets, counts) of the sampled documents, from a frame that holds the pairs as bytes.

    Only iterating brings them to the driver, a partition at a time.
    """

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def __len__(self) -> int:
        return self.rows.count()

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for row in self.rows.toLocalIterator():
            yield row["label"], np.frombuffer(row["buckets"], "<i4"), np.frombuffer(row["counts"], "<f4")

    def trained(self, buckets: int) -> Model:
        """The model, made in one task; zero weights if there are no rows."""
        for row in self.rows.repartition(1).mapInArrow(_trained(buckets), "weights binary, bias double").collect():
            return Model(np.frombuffer(row["weights"], "<f4"), row["bias"])
        return Model(np.zeros(buckets, np.float32), 0.0)


def train(rows: Sample | list[tuple[int, np.ndarray, np.ndarray]], buckets: int = FEATURES) -> Model:
    """Model of (label, buckets, counts): of a list made here, of a ``Sample`` in a task."""
    return rows.trained(buckets) if isinstance(rows, Sample) else _descended(rows, buckets)


def _trained(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, bytes, bytes]] = []
        for batch in batches:
            rows += zip(*(batch.column(name).to_pylist() for name in ("label", "buckets", "counts")))
        if not rows:
            return
        rows.sort()
        model = _descended([(label, np.frombuffer(at, "<i4"), np.frombuffer(n, "<f4")) for label, at, n in rows], buckets)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype("<f4").tobytes()], pa.binary()), pa.array([model.bias])], ["weights", "bias"])

    return run


def _descended(rows: list[tuple[int, np.ndarray, np.ndarray]], buckets: int) -> Model:
    """Stochastic gradient descent, one document a step."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (buckets, DIMENSION))
    output, bias = np.zeros((DIMENSION, 2)), np.zeros(2)
    steps = max(EPOCHS * len(rows), LEAST_STEPS)
    for step in range(steps):
        if step % len(rows) == 0:
            order = rng.permutation(len(rows))
        label, at, n = rows[order[step % len(rows)]]
        n = np.asarray(n, float)  # one document's, so that the sample stays as small as it came
        share = n / n.sum() if len(n) else n
        mean = share @ vectors[at]
        logits = mean @ output + bias
        odds = np.exp(logits - logits.max())
        error = odds / odds.sum()
        error[label] -= 1
        rate = RATE * (1 - step / steps)
        # Shares are small; a feature's step is scaled by the number of distinct ones.
        back = output @ error
        output -= rate * np.outer(mean, error)
        bias -= rate * 0.1 * error
        vectors[at] -= (rate * len(at) ** 0.5) * share[:, None] * back
    return Model((vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from texts (doc_id, text) and labels (doc_id, label 0 or 1).

    The sample is drawn from the narrow labels and ids and is bounded, so it is
    broadcast to the texts, which are not shuffled.
    """
    docs = stored(docs)
    known = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    order = F.xxhash64(F.col("doc_id").cast("string"))
    there = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    drawn = there.select("doc_id", F.col("label").cast("int").alias("label"), order.alias("h")).distinct().orderBy("h", "doc_id", "label")
    places = located(docs, "doc_id").join(F.broadcast(drawn.limit(sample).drop("h")), "doc_id")
    first = places.groupBy("doc_id", "label").agg(F.min(F.struct("file", "row")).alias("at")).select("label", "at.file", "at.row")
    first = stage(first, "quality-sample")
    chosen = located(docs, "text").join(F.broadcast(first), ["file", "row"]).select("label", "text")
    return train(Sample(chosen.mapInArrow(_sampled, "label int, buckets binary, counts binary")))


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            scores = [m.score(_bytes_of(text)) for text in batch.column("__text")]
            names = [name for name in batch.schema.names if name != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in names), pa.array(scores, pa.float64())], [*names, "__score"])

    return run


def score(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """``keep`` columns of ``docs`` and ``__score``, the probability of label 1."""
    rows = docs.select(*keep, F.col("text").alias("__text"))
    out = T.StructType([*rows.schema.fields[:-1], T.StructField("__score", T.DoubleType())])
    return rows.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), out)


def good(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """``docs`` with a score of at least ``threshold``; all their columns, in one scan."""
    return score(docs, model, F.col("*")).filter(F.col("__score") >= threshold).drop("__score")
