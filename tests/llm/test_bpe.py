"""BPE against the tokenizers library, and decoding as a round trip."""

import random
import struct

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from firstseen.llm import bpe, queries

PATH = queries.public_tokenizer()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def packed(library, texts):
    return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_whole_table(spark, library):
    folder = "/root/testdata/sf0.01"
    docs = queries.read(spark, folder, "documents")
    rows = {r.doc_id: r for r in queries.op10_bpe(spark, folder).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    import hashlib

    ids = dict(zip(texts, packed(library, list(texts.values()))))
    for doc_id, text in texts.items():
        row = rows.pop(doc_id)
        assert row.n_tokens * 4 == len(ids[doc_id])
        assert row.ids_sha256 == hashlib.sha256(ids[doc_id]).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert not rows


def test_random_texts(library):
    rng = random.Random(1)
    codes = [*range(0x250), *range(0x2000, 0x2070), 0x1680, 0x180E, 0x3000, 0xFEFF, 0x1F600, *range(0x660, 0x66A), *range(0x900, 0x930)]
    bits = [" ", "a", "'s", "\n", "  ", "aaaaaaa", "<|endoftext|>", "1", "!!", "é", "ing", "'ll", "\x1c", "\x85", "The"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(2000)]
    texts += ["".join(chr(rng.choice(codes)) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    texts += ["a" * 5000, "ab" * 3000, "", " " * 3000, "x" * 129]
    for cached in (50, 600_000):
        encoder = bpe.Encoder(bpe.Vocabulary(open(PATH, encoding="utf-8").read()), cached)
        found = [ids for i in range(0, len(texts), 700) for ids in encoder.encode(texts[i : i + 700])]
        assert found == packed(library, texts)
        assert [encoder.decode(ids) for ids in found] == texts


def test_nulls_clashing_columns_and_empty_table(spark):
    schema = "doc_id long, text string, ids int, `__ids` string"
    docs = spark.createDataFrame([(1, None, 4, "x"), (None, "", 5, "y"), (None, "hi", 6, None), (None, "hi", 6, None)], schema)
    encoded = bpe.encode(docs, PATH, F.col("doc_id"))
    rows = sorted((r.doc_id or 0, len(r.ids), r.text) for r in bpe.decode(encoded, PATH, F.col("doc_id"), F.col("ids")).collect())
    assert rows == [(0, 0, ""), (0, 4, "hi"), (0, 4, "hi"), (1, 0, "")]
    assert bpe.encode(docs.limit(0), PATH).count() == 0
