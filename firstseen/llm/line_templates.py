"""Line dedup by a log-template tree of fixed depth.

Each line goes down a tree: by its number of tokens, then by its DEPTH leading
tokens, where a token with a digit counts as variable. In the leaf, the other
fields are generalised: a token stays constant at its position if at least
DOCUMENTS lines of the leaf (one per document and distinct line) hold it there,
else the field is variable. Lines of equal pattern are one template; if at least
KEEP of its tokens are constant and at least DOCUMENTS documents hold it, it recurs
and all of its lines are dropped. A line that itself, digits aside, occurs in that
many documents recurs too; if tokens with digits leave less than KEEP of it constant,
it must occur in them digits included. So does a passage, a line of at least LONG tokens,
that two documents of different text hold word for word, digits included. A line
of fewer than TOKENS tokens is in no template; it recurs if DOCUMENTS documents hold
it, digits included.

Every step is a count by key that combines before its shuffle. Only the leaves
with enough documents have their lines looked at token by token, each distinct line
once. A very common line or token does not gather in one task when it is joined.

Defined results. Null text counts as empty and has no lines. Lines are separated by
line feeds; blank ones never recur and stay. A line repeated in one document counts once there. Repeated rows are other
documents with the same lines, but do not make a passage recur. Ids may be null or repeated: rows are told apart by
where they are stored. Whole texts are read; a task's memory is bounded by a batch
of them. Only ``doc_id`` and ``text`` are read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firstseen.llm.common import located, salted_join, spread_join, stored, with_facts
from firstseen.workspace import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEPTH = 3
TOKENS = 5
DOCUMENTS = 10
KEEP = 0.8
LONG = 50
FLUSH = 300_000
# By which count a line recurs, besides by its template.
_NEVER, _EXACT, _PASSAGE = 0, 1, 2
_ANY = "<*>"
_DIGIT = re.compile(r"[0-9]").search


def tokens_of(line: str) -> list[str]:
    tokens = line.split()
    return [_ANY if _DIGIT(token) else token for token in tokens] if _DIGIT(line) else tokens


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def keys_of(tokens: list[str]) -> tuple[int, int]:
    """(leaf, line): the leaf by count and leading tokens, the line by all of them."""
    return _hash(f"{len(tokens)} {' '.join(tokens[:DEPTH])}"), _hash(" ".join(tokens))


def _repeats(tokens: list[str], masked: list[str], keep: float) -> Iterator[tuple[int, int, int, bool]]:
    """(leaf, line, rule, general) under which a line is counted: digits aside, and as it stands."""
    if len(tokens) < TOKENS:
        if tokens:
            yield *keys_of(["", *tokens]), _EXACT, False
        return
    passage, same = len(tokens) >= LONG, _ANY not in masked
    enough = same or len(masked) - masked.count(_ANY) >= keep * len(masked)
    yield *keys_of(masked), _PASSAGE if passage and same else _EXACT if enough else _NEVER, True
    if not same and (passage or not enough):
        yield *keys_of(["", *tokens]), _PASSAGE if passage else _EXACT, False


def _parsed(with_tokens: bool, keep: float = KEEP):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled: set[tuple[int, int]] = set()
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                if len(spelled) > FLUSH:
                    spelled.clear()
                part = batch.slice(begin, 1000)
                rows, numbers, leaves, lines, rules, general, fresh, texts, words = ([] for _ in range(9))
                for i, text in enumerate(part.column("text").to_pylist()):
                    # A task spells a line out once, so a line of every document is no hot key.
                    seen = spelled if with_tokens else set()
                    digest = _hash(text) if text and not with_tokens else 0
                    for number, line in enumerate(text.split("\n")) if text else ():
                        masked = tokens_of(line)
                        for leaf, key, rule, wide in _repeats(line.split(), masked, keep):
                            new = (leaf, key) not in seen
                            seen.add((leaf, key))
                            if with_tokens and not (new and wide):
                                continue
                            leaves.append(leaf)
                            lines.append(key)
                            if with_tokens:
                                words.append(" ".join(masked))
                                continue
                            rows.append(i)
                            numbers.append(number)
                            rules.append(rule)
                            general.append(wide)
                            fresh.append(new)
                            texts.append(digest)
                keyed = [pa.array(leaves, pa.int64()), pa.array(lines, pa.int64())]
                if with_tokens:
                    yield pa.RecordBatch.from_arrays([*keyed, pa.array(words, pa.string())], ["leaf", "line", "tokens"])
                else:
                    place = part.select(["file", "row"]).take(pa.array(rows, pa.int64()))
                    facts = [pa.array(rules, pa.int32()), pa.array(general, pa.bool_()), pa.array(fresh, pa.bool_()), pa.array(texts, pa.int64())]
                    yield pa.RecordBatch.from_arrays(
                        [*place.columns, pa.array(numbers, pa.int32()), *keyed, *facts],
                        ["file", "row", "number", "leaf", "line", "rule", "general", "fresh", "digest"],
                    )

    return run


def recurring(docs: DataFrame, lines: DataFrame, documents: int = DOCUMENTS, keep: float = KEEP) -> DataFrame:
    """(leaf, line) of all lines that are dropped; ``lines`` is staged."""
    each = lines.filter("fresh").select("key.leaf", "key.line", "rule", "general", "digest")
    counts = stage(
        each.groupBy("leaf", "line", "rule", "general").agg(
            F.count(F.lit(1)).alias("n"), (F.min("digest") != F.max("digest")).alias("shared")
        ),
        "line-counts",
    )
    repeated = ((F.col("n") >= documents) & (F.col("rule") != _NEVER)) | ((F.col("rule") == _PASSAGE) & F.col("shared"))
    exact = counts.filter(repeated).select("leaf", "line")
    counts = counts.filter("general")
    # Leaves that can hold a template of more than one line.
    wide = counts.groupBy("leaf").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
    wide = wide.filter((F.col("all") >= documents) & (F.col("kinds") > 1)).select("leaf")
    open_lines = counts.join(wide, "leaf", "left_semi")
    texts = docs.select("text").mapInArrow(_parsed(True), "leaf long, line long, tokens string")
    spelled = texts.join(open_lines.hint("shuffle_hash"), ["leaf", "line"]).groupBy("leaf", "line").agg(
        F.first("n").alias("n"), F.min("tokens").alias("tokens")
    )
    each = stage(
        spelled.select("leaf", "line", "n", F.posexplode(F.split("tokens", " ")).alias("at", "token"))
        .withColumn("field", F.xxhash64("leaf", "at", "token")),
        "line-fields",
    )
    fixed = each.groupBy("field").agg(F.sum("n").alias("support"))
    marked = salted_join(each, fixed, "field", ["leaf", "line"])
    constant = (F.col("support") >= documents) & (F.col("token") != _ANY)
    patterns = marked.withColumn("constant", constant).groupBy("leaf", "line").agg(
        F.first("n").alias("n"), F.bit_xor(F.when(F.col("constant"), F.col("field")).otherwise(F.xxhash64("at"))).alias("pattern"),
        F.avg(F.col("constant").cast("int")).alias("share"),
    )
    patterns = stage(patterns.filter(F.col("share") >= keep).withColumn("template", F.xxhash64("leaf", "pattern")), "line-patterns")
    # The sum over a template's lines is at least the number of its documents, that of
    # its most common line at most; only between the two are documents told apart.
    held = patterns.groupBy("template").agg(F.sum("n").alias("all"), F.max("n").alias("most")).filter(F.col("all") >= documents)
    held = stage(held, "line-templates")
    common = held.filter(F.col("most") >= documents).select("template")
    unsure = spread_join(patterns, held.filter(F.col("most") < documents).select("template"), "template")
    unsure = stage(unsure.select(F.struct("leaf", "line").alias("key"), "template"), "unsure-lines")
    if not unsure.isEmpty():
        rows = lines.filter("fresh and general").select("file", "row", "key")
        holders = spread_join(rows, unsure, "key").select("template", "file", "row").distinct()
        counted = holders.groupBy("template").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= documents)
        common = common.union(counted.select("template"))
    general = spread_join(patterns, stage(common, "common-templates"), "template").select("leaf", "line")
    return exact.union(general).distinct()


def dropped_lines(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, file, row, n_lines, dropped (line numbers from 0)."""
    docs = stored(docs)
    text = F.col("text")
    rows = located(docs, "doc_id", F.when(text.isNull() | (text == ""), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).alias("n_lines"))
    schema = "file string, row long, number int, leaf long, line long, rule int, general boolean, fresh boolean, digest long"
    # Leaf and line together tell lines apart; one column joins them.
    key = F.struct("leaf", "line").alias("key")
    parsed = located(docs, "text").mapInArrow(_parsed(False, options.get("keep", KEEP)), schema)
    lines = stage(parsed.select("file", "row", "number", key, "rule", "general", "fresh", "digest"), "lines")
    unwanted = stage(recurring(docs, lines, **options).select(key), "recurring-lines")
    found = spread_join(lines.select("file", "row", "number", "key"), unwanted, "key")
    per_row = found.groupBy("file", "row").agg(F.array_sort(F.collect_set("number")).alias("dropped"))
    return rows.join(per_row, ["file", "row"], "left").select(
        "doc_id", "file", "row", "n_lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped")
    )


def without_recurring_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text``."""
    docs = stored(docs)
    facts = dropped_lines(docs, **options).select("file", "row", F.col("dropped").alias("__dropped"))
    rows = with_facts(docs, facts, "inner")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("__dropped", i))
    changed = F.when(F.size("__dropped") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    return rows.withColumn("text", changed).drop("__dropped")
