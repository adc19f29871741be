"""Spelling variants by search schemes on bidirectional FM-indexes.

The words of a vocabulary are near if one inserted, deleted or replaced letter tells
them apart. A word is cut in halves; a near word has one half unchanged. So two
searches find all near words: match the left half exactly, from the middle to the mark
before the word, then extend to the right across the other half with one error; or match
the right half exactly to the mark behind the word, then extend to the left with one error. An
index holds its words between marks, as two suffix arrays, of the text and of the
reversed text, whose rank intervals are kept in step; so a match grows at either end, and
a whole word ends up as an interval of one rank, which names it.

The vocabulary is dealt out by half: a word looks for near words among those with the same left
half, and among those with the same right half, so a word lies in at most two keys a side,
for the two lengths a half of its neighbours can have. An index takes several keys, half of PIECE
rows in the mean; a key of more than PIECE is dealt out over chunks by hash, and the words that ask go
to each of them. A near word found from the left is not counted again from the right. Tasks return
one row per word: how many near words, and the most frequent.

Forms are more frequent than their words by a factor, so following them ends; the last is found by
doubling the steps, a join a round.

Defined results. Null texts have no words; a null ``doc_id`` counts as an empty one in the hash
that plants errors. Repeated rows are counted as often as they occur, with the same words. Whole texts are
read; a task's memory is bounded by its longest text, FLUSH counts and one index. Ties go to the first word in code point order. Other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstseen.llm.common import spread_join
from firstseen.workspace import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHORTEST, LEAST, FACTOR, EVERY = 5, 3, 2, 97
FLUSH = 500_000
PIECE = 100_000
# Letters A-Z in either case and U+00C0 to U+00FF, as UTF-8 with A-Z lowered.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_END, _MARK = 0, 1


def words_of(doc_id, text: bytes | None) -> Counter:
    """Words of a text; one of EVERY, chosen by a hash of id and word, loses a letter."""
    found = Counter(_RUN.findall((text or b"").lower()))
    seed = zlib.crc32(b"%s:" % ("" if doc_id is None else str(doc_id)).encode())
    for run in [run for run in found if zlib.crc32(run, seed) % EVERY == 0]:
        letters = run.decode()
        at = zlib.crc32(run, seed) % len(letters)
        found[(letters[:at] + letters[at + 1 :]).encode() + b"\n"] += found.pop(run)
    words: Counter = Counter()
    for run, n in found.items():
        words[run.removesuffix(b"\n")] += n
    return words


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        words = pa.array([*counts], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array([*counts.values()], pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            counts.update(words_of(doc_id, text.as_py()))
            if len(counts) > FLUSH:
                yield flush()
                counts.clear()
    yield flush()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least SHORTEST letters that occur at least LEAST times."""
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(_count, "word string, n long").filter(F.length("word") >= SHORTEST)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


class _Ranks:
    """How often a symbol, or one below it, stands before a place of a sequence."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        blocks = len(sequence) // 64 + 1
        padded = np.full(blocks * 64, symbols, sequence.dtype)
        padded[: len(sequence)] = sequence
        self.bits = np.empty((symbols + 1, blocks), np.uint64)
        self.before = np.zeros((symbols + 1, blocks), np.int32)
        for symbol in range(symbols + 1):
            self.bits[symbol] = np.packbits(padded < symbol, bitorder="little").view("<u8")
            self.before[symbol, 1:] = np.bitwise_count(self.bits[symbol, :-1]).cumsum(dtype=np.int32)
        self.below = np.array([np.count_nonzero(sequence < symbol) for symbol in range(symbols + 1)], np.int64)

    def less(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Symbols below ``symbol`` before ``place``."""
        block, bit = place >> 6, (place & 63).astype(np.uint64)
        part = self.bits[symbol, block] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[symbol, block] + np.bitwise_count(part).astype(np.int64)


def _suffixes(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; the last symbol is unique and the smallest."""
    rank, step = text.astype(np.int64), 1
    while True:
        ahead = np.zeros(len(text), np.int64)
        ahead[: max(len(text) - step, 0)] = rank[step:] + 1
        key = rank * (len(text) + 2) + ahead
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[False], key[order][1:] != key[order][:-1]])
        rank = np.empty(len(text), np.int64)
        rank[order] = new.cumsum()
        if rank[order[-1]] == len(text) - 1:
            return order
        step *= 2


class Matches:
    """Rank intervals in both directions, of as many matches as ``who`` (the patterns) has entries.
    Index 0 is the text, which grows to the left, 1 the reversed text, to the right."""

    def __init__(self, who: np.ndarray, low: list[np.ndarray], size: np.ndarray):
        self.who, self.low, self.size = who, low, size

    def pick(self, which: np.ndarray) -> Matches:
        return Matches(self.who[which], [low[which] for low in self.low], self.size[which])


class Index:
    """A bidirectional FM-index over distinct words."""

    def __init__(self, words: list[str], alphabet: set[str]):
        joined = "\n" + "".join(word + "\n" for word in words)
        self.letters = np.array(sorted(map(ord, alphabet | {"\n"})), np.uint32)  # the mark is the smallest
        text = np.concatenate([self._coded(joined), [_END]])
        self.symbols, self.n = len(self.letters) + 1, len(text)
        self.ranks, self.suffixes = [], None
        for sequence in (text, np.concatenate([text[:-1][::-1], [_END]])):
            order = _suffixes(sequence)
            self.ranks.append(_Ranks(sequence[order - 1], self.symbols))
            self.suffixes = order if self.suffixes is None else self.suffixes
        self.begins = np.flatnonzero(text == _MARK)  # the mark before each word, and one behind the last

    def _coded(self, letters: str) -> np.ndarray:
        return np.searchsorted(self.letters, np.frombuffer(letters.encode("utf-32-le"), "<u4")) + _MARK

    def code(self, words: list[str]) -> np.ndarray:
        """Words of one length, in letters of the alphabet, as rows of symbols."""
        return self._coded("".join(words)).reshape(len(words), -1)

    def everywhere(self, n: int) -> Matches:
        return Matches(np.arange(n), [np.zeros(n, np.int64), np.zeros(n, np.int64)], np.full(n, self.n, np.int64))

    def grow(self, found: Matches, symbol: np.ndarray | int, way: int) -> Matches:
        """Matches with one more symbol, at the left (0) or the right (1); those without are left out."""
        symbol = np.broadcast_to(np.asarray(symbol, np.int64), found.size.shape)
        ranks, low = self.ranks[way], found.low[way]
        high = low + found.size
        under, over = ranks.less(symbol, low), ranks.less(symbol, high)
        with_low = ranks.less(symbol + 1, low) - under
        size = ranks.less(symbol + 1, high) - over - with_low
        lows = [ranks.below[symbol] + with_low, found.low[1 - way] + over - under]
        grown = Matches(found.who, lows if way == 0 else lows[::-1], size)
        return grown.pick(np.flatnonzero(size > 0))

    def words_at(self, found: Matches) -> np.ndarray:
        """Numbers of the words whose marked match each interval is."""
        return np.searchsorted(self.begins, self.suffixes[found.low[0]])

    def near(self, patterns: np.ndarray, way: int) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word) one error apart in the half that the way goes to: 1 the right, 0 the left one."""
        n, length = patterns.shape
        middle = length // 2
        exact = range(middle - 1, -1, -1) if way else range(middle, length)
        open_half = [*range(middle, length)] if way else [*range(middle - 1, -1, -1)]
        state = self.everywhere(n)
        for at in exact:
            state = self.grow(state, patterns[state.who, at], 1 - way)
        state = self.grow(state, _MARK, 1 - way)
        ended = []

        def finish(matches: Matches, rest: list[int]) -> None:
            for at in rest:
                if not len(matches.who):
                    return
                matches = self.grow(matches, patterns[matches.who, at], way)
            matches = self.grow(matches, _MARK, way)
            ended.append((matches.who, self.words_at(matches)))

        for done in range(len(open_half) + 1):
            rest = open_half[done:]
            if not len(state.who):
                break
            # Every letter that follows, but the pattern's own: replaces it, or stands before it.
            follows = np.repeat(np.arange(len(state.who)), self.symbols - 2)
            letters = np.tile(np.arange(_MARK + 1, self.symbols), len(state.who))
            if rest:
                other = letters != patterns[state.who[follows], rest[0]]
                follows, letters = follows[other], letters[other]
            for part in range(0, len(follows), 1 << 20):
                inserted = self.grow(state.pick(follows[part : part + (1 << 20)]), letters[part : part + (1 << 20)], way)
                finish(inserted, rest)
                if rest:
                    finish(inserted, rest[1:])
            if rest:
                finish(state, rest[1:])
                state = self.grow(state, patterns[state.who, rest[0]], way)
        who, what = (np.concatenate(x) for x in zip(*ended)) if ended else (np.empty(0, np.int64),) * 2
        return tuple(np.unique(np.stack([who, what]), axis=1))


def _near_in(words: list[str], counts: np.ndarray, listed: np.ndarray, asks: np.ndarray, side: int) -> dict[str, list]:
    """What the words that ``asks`` numbers find among those that ``listed`` does, as columns of rows by word."""
    index = Index([words[i] for i in listed], set("".join(words)))
    out: dict[str, list] = {name: [] for name in ("word", "n_near", "form_n", "form")}
    names, lengths = np.array(words, object), np.array([*map(len, words)])
    for length in np.unique(lengths[asks]).tolist():
        chosen = asks[lengths[asks] == length]
        for begin in range(0, len(chosen), 1 << 14):
            part = chosen[begin : begin + (1 << 14)]
            who, what = index.near(index.code([words[i] for i in part]), 1 - side)
            what = listed[what]
            if side:  # the search from the left has found those with an equal left half
                half = length // 2
                new = np.fromiter((names[part[a]][:half] != names[b][:half] for a, b in zip(who, what)), bool, len(who))
                who, what = who[new], what[new]
            if not len(who):
                continue
            order = np.lexsort((names[what].astype(str), -counts[what], who))
            who, what = who[order], what[order]
            first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            out["word"] += names[part[who[first]]].tolist()
            out["n_near"] += np.diff(np.append(first, len(who))).tolist()
            out["form_n"] += counts[what[first]].tolist()
            out["form"] += names[what[first]].tolist()
    return out


_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])


def _search(unit: pa.Table) -> pa.Table:
    """One index: over the words that are listed, for those that ask. A word that stands in several keys is one."""
    side = unit.column("side")[0].as_py()
    words = unit.group_by("word").aggregate([("n", "min"), ("asks", "max"), ("listed", "max")])
    listed, asks = (np.flatnonzero(words.column(name).to_numpy()) for name in ("listed_max", "asks_max"))
    found = _near_in(words.column("word").to_pylist(), words.column("n_min").to_numpy(), listed, asks, side)
    return pa.Table.from_pydict(found, _FOUND)


def near_words(words: DataFrame, piece: int = PIECE) -> DataFrame:
    """(word, n_near, best) of the ``words`` (word, n; staged) with near ones: how many, and the most
    frequent as a struct of its count, negative, and itself."""
    lengths = "sequence(length(word) - 1, length(word) + 1)"
    halves = [(0, f"transform({lengths}, m -> left(word, m div 2))", "left(word, length(word) div 2)"),
              (1, f"transform({lengths}, m -> right(word, m - m div 2))", "right(word, length(word) - length(word) div 2)")]
    dealt = None
    for side, every, own in halves:
        one = words.select("word", "n", F.lit(side).alias("side"), F.explode(F.array_distinct(F.expr(every))).alias("key"), F.expr(own).alias("own"))
        dealt = one if dealt is None else dealt.unionByName(one)
    dealt = dealt.withColumn("asks", F.col("key") == F.col("own")).drop("own")
    counts = dealt.groupBy("side", "key").agg(F.count(F.lit(1)).alias("rows"))
    # One key in `piece` words at most: with 10^9 words some megabytes.
    chunks = F.ceil(F.col("rows") * 2 / piece).cast("int").alias("chunks")
    crowded = stage(counts.filter(F.col("rows") > piece).select("side", "key", chunks), "crowded-keys")
    units = max(1, -(-2 * 4 * words.count() // piece))
    met = dealt.join(F.broadcast(crowded), ["side", "key"], "left")
    chunk = F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")
    at = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(-1))).when(F.col("asks"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(chunk)))
    met = met.withColumn("home", F.coalesce(chunk, F.lit(-1))).withColumn("chunk", at)
    # An index takes several whole keys, or one chunk of one key.
    unit = F.when(F.col("chunk") < 0, F.pmod(F.xxhash64("key"), F.lit(units)).cast("string")).otherwise(F.concat_ws(" ", "key", "chunk"))
    rows = met.select("side", unit.alias("unit"), "word", "n", "asks", (F.col("home") == F.col("chunk")).alias("listed"))
    found = rows.groupBy("side", "unit").applyInArrow(_search, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)


def _last(links: DataFrame) -> DataFrame:
    """(word, root): the ends of the chains that ``links`` (word, to), staged, begin."""
    while True:
        further = links.select(F.col("word").alias("to"), F.col("to").alias("further"))
        hops = stage(spread_join(links, further, "to", "left"), "hops")
        if hops.filter("further is not null").isEmpty():
            return links.select("word", F.col("to").alias("root"))
        links = stage(hops.select("word", F.coalesce("further", "to").alias("to")), "forms")


def variants(docs: DataFrame, piece: int = PIECE, factor: int = FACTOR) -> DataFrame:
    """One row per word of the texts: word, form, root, n, n_near, form_n."""
    words = stage(vocabulary(docs), "vocabulary")
    near = words.join(near_words(words, piece), "word", "left")
    enough = -F.col("best.less") >= factor * F.col("n")
    near = near.select(
        "word", F.when(enough, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    near = stage(near, "near-words")
    links = stage(near.filter("form is not null").select("word", F.col("form").alias("to")), "forms")
    return near.join(_last(links), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
