"""Language identification: word scores first, then shorter and shorter n-grams.

Fitting counts, over all labelled documents, how often each language uses each
word and each character n-gram of the padded word; tasks count before the
shuffle. All counts are kept, as one staged table; scores are smoothed log
frequencies per language.

A known word adds its scores. Any other word adds the mean scores of its known
n-grams of the greatest length that has any, down to single letters. The
language with the largest sum is predicted; its posterior is the score.

Only the most frequent words of each language are broadcast, WORDS in all and as
many of each language, and summed where the text is read. That bounds the broadcast
and changes no result: a text's other words are joined to the staged table, and those
it does not hold to its n-grams, each distinct word once. Tables in between are deleted
once nothing reads them. Scores are whole numbers
of 1 / SCALE, so their sums do not depend on order.

Defined results. Letters are what Unicode calls so, without digits, numerals and marks. A null text, or one without letters, is ``und`` with score 0; so
is everything if no labelled document has a letter. A text none of whose
letters was ever seen gets the most frequent language. Ties go to the first
language in code point order. Null languages are not learned from. Repeated rows
count as often as they occur, and get equal results. Whole texts are read; a
task's memory is bounded by its longest text and by FLUSH counts. Extra columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firstseen.llm.common import drop, spread_join
from firstseen.workspace import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 100_000
LONGEST = 4
FLUSH = 300_000
PARTS = 64
SMOOTHING = 0.5
SCALE = 1 << 32
UNDETERMINED = "und"
_RUNS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case. Word characters that are no letters, such as fractions, are rare: only runs that hold one are cut."""
    runs = _RUNS.findall(text.lower())
    if all(map(str.isalpha, runs)):
        return runs
    return [word for run in runs for word in "".join(c if c.isalpha() else " " for c in run).split()]


def grams_of(word: str, length: int) -> list[str]:
    padded = f"<{word}>" if length > 1 else word
    return [padded[i : i + length] for i in range(len(padded) - length + 1)]


def gram_counts(words: Counter, longest: int = LONGEST) -> dict[int, Counter]:
    """Counts of the words' n-grams by length. Shorter ones are the heads of longer
    ones, plus one at each word's end, so only the longest are cut out of words."""
    counts: dict[int, Counter] = {}
    above: Counter = Counter()
    for length in range(longest, 0, -1):
        grams: Counter = Counter()
        if length == longest:
            for word, n in words.items():
                padded = f"<{word}>"
                for i in range(len(padded) - length + 1):
                    grams[padded[i : i + length]] += n
        else:
            for gram, n in above.items():
                grams[gram[:length]] += n
            for word, n in words.items():
                if len(word) + 2 >= length:
                    grams[f"<{word}>"[-length:]] += n
        counts[length] = above = grams
    counts[1] = Counter({gram: n for gram, n in counts[1].items() if gram not in "<>"})
    return counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, length, gram, n) of a task's texts; length 0 are words."""
    counts: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            for length, grams in [(0, words), *gram_counts(words).items()]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams)), pa.array([length] * len(grams), pa.int32()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())],
                    ["lang", "length", "gram", "n"],
                )
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, counts.values())) > FLUSH:
            yield from flush()
    yield from flush()


class Model:
    """``langs`` in code point order; ``prior`` and ``common`` (scores of the most
    frequent words) by language; ``scores`` (length, gram, scores) holds everything."""

    def __init__(self, langs: list[str], prior: list[int], common: dict[str, list[int]], scores: DataFrame | None):
        self.langs, self.prior, self.common, self.scores = langs, prior, common, scores


def fit(docs: DataFrame, words: int = WORDS) -> Model:
    """Model of the documents with text and language; counts cover all of them."""
    labelled = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text")).filter("lang is not null and text is not null")
    counted = labelled.mapInArrow(_count, "lang string, length int, gram string, n long")
    summed = counted.groupBy("lang", "length", "gram").agg(F.sum("n").alias("n"))
    by = F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")
    counts = stage(summed.groupBy("length", "gram").agg(by), "language-counts")
    each = counts.select("length", "gram", F.explode("by").alias("lang", "n"))
    totals = each.groupBy("length", "lang").agg(F.sum("n").alias("n")).collect()  # a row per language and length
    kinds = {r["length"]: r["count"] for r in counts.groupBy("length").count().collect()}
    langs = sorted({row["lang"] for row in totals})
    if not langs:
        return Model([], [], {}, None)
    used = {(r["length"], r["lang"]): r["n"] for r in totals}

    def score(lang: str) -> Column:
        below = [float(used.get((length, lang), 0) + SMOOTHING * (kinds.get(length, 0) + 1)) for length in range(LONGEST + 1)]
        share = (F.coalesce(F.col("by")[lang], F.lit(0)) + SMOOTHING) / F.element_at(F.lit(below), F.col("length") + 1)
        return F.round(F.log(share) * SCALE).cast("long")

    scores = counts.select("length", "gram", F.array(*map(score, langs)).alias("scores"))
    share = max(1, words // len(langs))
    # First the most frequent of each part of a language, then of those.
    best = each.filter("length = 0").withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):
        frequent = Window.partitionBy(*by).orderBy(F.desc("n"), "gram")
        best = best.withColumn("rank", F.row_number().over(frequent)).filter(F.col("rank") <= share)
    best = best.select("gram").distinct()
    common = scores.filter("length = 0").join(F.broadcast(best), "gram", "left_semi").collect()
    spoken = np.array([used.get((0, lang), 0) + 1 for lang in langs], float)
    prior = [round(p * SCALE) for p in np.log(spoken / spoken.sum()).tolist()]
    return Model(langs, prior, {r["gram"]: r["scores"] for r in common}, scores)


def _parts(shared, n_langs: int):
    """Per text: whether it has words, the sums of its common words, its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        place = {word: i for i, word in enumerate(common)}
        table = np.array(list(common.values()), np.int64).reshape(len(common), n_langs)
        for batch in batches:
            sums = np.zeros((batch.num_rows, n_langs), np.int64)
            spoken, ends, words, times = [], [0], [], []
            for i, text in enumerate(batch.column("text")):
                counts = Counter(words_of(text.as_py() or ""))
                spoken.append(bool(counts))
                rows, n = [], []
                for word, k in counts.items():
                    at = place.get(word)
                    if at is None:
                        words.append(word)
                        times.append(k)
                    else:
                        rows.append(at)
                        n.append(k)
                if rows:
                    sums[i] = np.array(n, np.int64) @ table[np.array(rows)]
                ends.append(len(words))
            rest = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(times, pa.int64())], ["word", "n"])
            starts = np.arange(batch.num_rows + 1, dtype=np.int32) * n_langs
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in names), pa.array(spoken, pa.bool_()),
                    pa.ListArray.from_arrays(pa.array(starts), pa.array(sums.ravel())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest),
                ],
                [*names, "__spoken", "__sums", "__rest"],
            )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, gram) of words: all their n-grams of every length."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 1000):
            words, grams = [], []
            for word in batch.column("word").slice(begin, 1000).to_pylist():
                for length in range(1, LONGEST + 1):
                    found = grams_of(word, length)
                    words += [word] * len(found)
                    grams += found
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(grams, pa.string())], ["word", "gram"])


def _word_scores(words: DataFrame, model: Model) -> DataFrame:
    """(word, scores), staged, of distinct ``words`` that are known or have known n-grams."""
    at = range(len(model.langs))
    known = model.scores.filter("length = 0").select(F.col("gram").alias("word"), "scores")
    looked_up = stage(words.join(known, "word", "left"), "language-words")
    absent = looked_up.filter("scores is null").select("word")
    cut = stage(absent.mapInArrow(_cut, "word string, gram string"), "language-grams")
    # An n-gram's own length tells which count it needs.
    met = spread_join(cut, model.scores.filter("length > 0"), "gram")
    sums = met.groupBy("word", "length").agg(F.count(F.lit(1)).alias("k"), *(F.sum(F.col("scores")[i]).alias(f"s{i}") for i in at))
    longest = sums.groupBy("word").agg(F.max(F.struct("length", F.array(*(F.expr(f"s{i} div k") for i in at)).alias("scores"))).alias("best"))
    found = looked_up.filter("scores is not null").unionByName(longest.select("word", F.col("best.scores").alias("scores")))
    scored = stage(found, "language-scores")
    drop(looked_up, cut)
    return scored


def predict(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """``keep`` columns of ``docs``, ``lang_pred`` and ``score``."""
    rows = docs.select(*keep, F.col("text"))
    names = [field.name for field in rows.schema if field.name != "text"]
    if not model.langs:
        return rows.select(*names, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    at = range(len(model.langs))
    extra = T.StructType.fromDDL("__spoken boolean, __sums array<bigint>, __rest array<struct<word: string, n: bigint>>")
    out = T.StructType([*(field for field in rows.schema if field.name != "text"), *extra])
    shared = docs.sparkSession.sparkContext.broadcast(model.common)
    parts = rows.mapInArrow(_parts(shared, len(model.langs)), out).withColumn("__id", F.monotonically_increasing_id())
    parts = stage(parts, "language-parts")
    rest = parts.select("__id", F.inline("__rest"))
    scored = _word_scores(rest.select("word").distinct(), model)
    met = spread_join(rest, scored, "word")
    sums = met.groupBy("__id").agg(F.array(*(F.sum(F.col("n") * F.col("scores")[i]) for i in at)).alias("__more"))
    sums = stage(sums, "language-sums")
    drop(scored)
    total = F.array(*(F.col("__sums")[i] + F.coalesce(F.col("__more")[i], F.lit(0)) + model.prior[i] for i in at))
    joined = parts.drop("__rest").join(sums, "__id", "left").withColumn("__total", total)
    best = F.array_max("__total")
    odds = F.aggregate("__total", F.lit(0.0), lambda sum_, each: sum_ + F.exp((each - best) / SCALE))
    return joined.select(
        *names,
        F.when(F.col("__spoken"), F.lit(model.langs)[F.array_position("__total", best).cast("int") - 1]).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(F.col("__spoken"), 1 / odds).otherwise(0.0).alias("score"),
    )
