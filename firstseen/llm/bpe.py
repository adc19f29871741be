"""Byte-level BPE by prefix-sharing trie traversal.

Texts are cut into pieces by the tokenizer's pattern. A batch's distinct new
pieces, sorted, are a trie in depth-first order: a piece shares all states with
the one before it up to their common prefix. The state of a node is the last
token of the encoding of its prefix. That is enough, because the encoding of a
prefix without its last token is again a prefix's encoding, so walking back from
a node gives all of its tokens. The last token of a prefix is the one token that
ends it and may follow the state where it begins, and whether two tokens may stand
side by side depends on those two alone. States of shared prefixes are computed
once.

Ids are little-endian unsigned 32-bit integers in one binary value, the form
shards of token ids have; ``decode`` turns them back.

Defined results. Null text counts as empty: no ids. The special token's string in
a text becomes its id, as in the tokenizer's own encoding, and is decoded as that
string. Whole texts are encoded, ROWS at a time; a task keeps at most CACHED chunks
and pieces beside, and a very long text needs memory in proportion to its length. Repeated rows get equal ids.
Only the named columns are read. An empty table gives an empty result. Null ids
decode to an empty text.
"""

from __future__ import annotations

import gc
import json
import struct
import sys
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED = 700_000
ROWS = 1_000  # texts that are cut and sorted together
_NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens of a tokenizer file: bytes, and the merge that makes each of them."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE tokenizer")
        alphabet = byte_alphabet()
        spelled = lambda token: bytes(map(alphabet.__getitem__, token))
        self.id_of = {spelled(token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        self.bytes_of = {i: token for token, i in self.id_of.items()}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made_of: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for order, merge in enumerate(spec["model"]["merges"]):
            left, right = map(spelled, merge.split(" ") if isinstance(merge, str) else merge)
            pair, whole = (self.id_of[left], self.id_of[right]), self.id_of[left + right]
            self.rank[pair] = order
            if whole not in self.born:
                self.made_of[whole], self.born[whole] = pair, order
        # Tokens whose own bytes are encoded as that token; others never occur.
        self.usable = {token: i for token, i in self.id_of.items() if self.merged(token) == [i]}
        self.longest = max(map(len, self.usable))
        self.beside: dict[int, bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The definition of BPE: apply the first merge of the list, leftmost, until none fits."""
        ids = [self.id_of[piece[i : i + 1]] for i in range(len(piece))]
        while len(ids) > 1:
            order, at = min((self.rank.get(pair, _NEVER), i) for i, pair in enumerate(zip(ids, ids[1:])))
            if order == _NEVER:
                break
            ids[at : at + 2] = [self.id_of[self.bytes_of[ids[at]] + self.bytes_of[ids[at + 1]]]]
        return ids

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge ever crosses the border between the two tokens.

        Undoes the merges of both tokens, latest first. While ``a`` ends the left
        and ``b`` begins the right token, their own merge must not come before
        the merge that uses up ``a`` (which stands to the left and wins a draw)
        nor before or with the one that uses up ``b``.
        """
        a, b, a_used, b_used, free = left, right, _NEVER, _NEVER, True
        while True:
            order = self.rank.get((a, b), _NEVER)
            if order < a_used and order <= b_used and order < _NEVER:
                free = False
                break
            a_born, b_born = self.born.get(a, -1), self.born.get(b, -1)
            if a_born > b_born:
                a, a_used = self.made_of[a][1], a_born
            elif b_born >= 0:
                b, b_used = self.made_of[b][0], b_born
            else:
                break
        self.beside[left << 32 | right] = free
        return free

    def encode_sorted(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Ids of each of the sorted pieces: a depth-first walk of their trie."""
        last: list[int] = [-1]
        before = b""
        token_of, beside, bytes_of, longest = self.usable.get, self.beside.get, self.bytes_of, self.longest
        for piece in pieces:
            shared, most = 0, min(len(before), len(piece))
            while shared < most and before[shared] == piece[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(piece) + 1):
                for begin in range(end - 1, max(end - longest, 0) - 1, -1):
                    token = token_of(piece[begin:end])
                    if token is None:
                        continue
                    if begin:
                        free = beside(last[begin] << 32 | token)
                        if not (self.may_follow(last[begin], token) if free is None else free):
                            continue
                    last.append(token)
                    break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            ids, end = [], len(piece)
            while end:
                ids.append(last[end])
                end -= len(bytes_of[last[end]])
            ids.reverse()
            before = piece
            yield ids


class Encoder:
    """Encodes many texts with one cache.

    Text is first split before single spaces, where a piece always begins; the
    pattern then runs once per distinct chunk. A chunk with white space at an edge
    depends on its neighbours, so a text with one is cut by the pattern as a whole.
    """

    def __init__(self, vocabulary: Vocabulary, cached: int = CACHED):
        self.vocabulary = vocabulary
        self.cached = cached
        self.chunks: dict[str, bytes | None] = {}  # without their space; None: cut the whole text
        self.pieces: dict[str, bytes] = {}
        self.cut = regex.compile(PATTERN).findall
        self.edged = regex.compile(r"^$|^\s|\s$").search
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else lambda text: [text]

    def _learn(self, wanted: set[str]) -> None:
        """Make sure that the encodings of all these pieces are cached."""
        fresh = {piece for piece in wanted if piece not in self.pieces}
        if len(self.pieces) + len(fresh) > self.cached:
            self.pieces.clear()
            fresh = wanted
        spelled = sorted((piece.encode(), piece) for piece in fresh)
        for (_, piece), ids in zip(spelled, self.vocabulary.encode_sorted([b for b, _ in spelled])):
            self.pieces[piece] = struct.pack(f"<{len(ids)}I", *ids)

    def _learn_chunks(self, wanted: set[str]) -> None:
        fresh = [chunk for chunk in wanted if chunk not in self.chunks]
        if len(self.chunks) + len(fresh) > self.cached:
            self.chunks.clear()
            fresh = list(wanted)
        cut = {chunk: None if self.edged(chunk) else self.cut(" " + chunk) for chunk in fresh}
        self._learn({piece for pieces in cut.values() if pieces for piece in pieces})
        get = self.pieces.__getitem__
        for chunk, pieces in cut.items():
            self.chunks[chunk] = None if pieces is None else b"".join(map(get, pieces))

    def _whole(self, text: str) -> bytes:
        pieces = self.cut(text)
        self._learn(set(pieces))
        return b"".join(map(self.pieces.__getitem__, pieces))

    def _part(self, first: str, rest: list[str]) -> bytes:
        """Ids of the text whose chunks these are; those of ``rest`` are cached."""
        if not (rest and self.edged(first)):
            try:
                return self._whole(first) + b"".join(map(self.chunks.__getitem__, rest))
            except TypeError:  # a None among them
                pass
        return self._whole(" ".join([first, *rest]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        special = self.vocabulary.special
        split: list[list] = []
        wanted: set[str] = set()
        for text in texts:
            parts: list = []
            for part in self.split(text or ""):
                if part in special:
                    parts.append(struct.pack("<I", special[part]))
                elif part:
                    first, *rest = part.split(" ")
                    wanted.update(rest)
                    parts.append((first, rest))
            split.append(parts)
        self._learn_chunks(wanted)
        return [b"".join([part if isinstance(part, bytes) else self._part(*part) for part in parts]) for parts in split]

    def decode(self, ids: bytes | None) -> str:
        tokens = struct.unpack(f"<{len(ids) // 4}I", ids) if ids else ()
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, tokens)).decode("utf-8", "replace")


def _encoded(shared, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # no cycles here; tracing millions of pieces would take a third of the time
        encoder = shared.value  # with what earlier tasks of this worker have cached
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                found = encoder.encode(part.column("__text").to_pylist())
                arrays, names = list(part.columns[:-1]), part.schema.names[:-1]
                arrays.append(pa.array(found, pa.binary()))
                if back:
                    arrays.append(pa.array([encoder.decode(ids) for ids in found], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, [*names, "ids", "decoded"][: len(arrays)])

    return run


def _decoded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            found = [encoder.decode(ids) for ids in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], [*batch.schema.names[:-1], "text"])

    return run


def _tokenizer(docs: DataFrame, path: str):
    """An encoder, its file read once on the driver, broadcast: a fixed size of some MB."""
    with open(path, encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast(Encoder(Vocabulary(file.read())))


def encode(docs: DataFrame, path: str, *keep: Column, back: bool = False) -> DataFrame:
    """``keep`` columns of ``docs`` and ``ids``, the encoding of ``text``.

    ``back`` adds ``decoded``, the text decoded again from the ids.
    """
    rows = docs.select(*keep, F.col("text").alias("__text"))
    fields = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    out = T.StructType([*rows.schema.fields[:-1], *fields[: 1 + back]])
    return rows.mapInArrow(_encoded(_tokenizer(docs, path), back), out)


def decode(encoded: DataFrame, path: str, *keep: Column) -> DataFrame:
    """``keep`` columns of ``encoded`` and ``text``, decoded from ``ids``."""
    rows = encoded.select(*keep, F.col("ids").alias("__ids"))
    out = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType())])
    return rows.mapInArrow(_decoded(_tokenizer(encoded, path)), out)
