"""Ranked search against a model that scores every document for every item."""

import math
import random
import re
from collections import Counter

import pytest

from firstseen.llm import lexical_search as ls

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def model(docs, items, k=ls.K):
    counted = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    counted = [(i, c) for i, c in counted if c]
    total = sum(c.total() for _, c in counted)
    holding = Counter(t for _, c in counted for t in c)
    big = len(counted)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in counted:
            m = 100 - 75 + (75 * c.total() * big) // total
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * big + 2) / (2 * holding[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def corpus(seed):
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(300)] + ["Été", "你好", "A1", "x_y"]
    weights = [1 / (i + 3) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(300)]
    items = [(i, ", ".join(rng.choices(words, weights, k=rng.randint(1, 12)))) for i in range(25)]
    items += [(30 + i, docs[i * 7][1]) for i in range(5)]  # a document itself
    return docs, items


@pytest.mark.parametrize("seeds, rows, block", [(ls.SEEDS, ls.BUCKET_ROWS, ls.BLOCK), (40, 16, ls.BLOCK), (0, 7, 300)])
def test_random_texts(spark, monkeypatch, seeds, rows, block):
    monkeypatch.setattr(ls, "SEEDS", seeds)
    monkeypatch.setattr(ls, "BUCKET_ROWS", rows)
    docs, items = corpus(4)
    docs += [(500, None), (501, ""), (502, "t5 " * 20_000), (None, docs[3][1]), (3, docs[3][1]), (777, docs[3][1]), (778, docs[3][1])]
    items += [(90, None), (91, "..."), (92, "nowhere else"), (None, "t1 t1 t2"), (93, docs[3][1])]
    found = ls.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block=block)
    assert order(tuple(r)[:4] for r in found.collect()) == order(model(docs, items))


def test_buckets_are_pruned():
    """An item whose floor no vector can reach opens no list."""
    import numpy as np

    items = ls.Items([(0, b"a b c"), (1, b"a")])
    bucket = ls.Bucket(np.array([0, 0, 1]), np.array([0, 1, 0]), np.array([30, 40, 7]), np.array([50.0, 7.0]))
    assert [(i, r.tolist(), s.tolist()) for i, r, s in bucket.search(items, np.array([60, 8]))] == [(0, [0], [70]), (1, [0], [30])]
    assert list(bucket.search(items, np.array([71, 31]))) == []


def test_repeated_items_empty_tables_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "one two", "z", 3), (2, "two three", "y", 4)], "doc_id long, text string, file string, n long")
    items = spark.createDataFrame([(1, "two", 5), (1, "two", 6), (1, "three", 7)], "item_id long, text string, rank long")
    found = sorted((r.item_id, r["rank"], r.doc_id) for r in ls.search(docs, items).collect())
    assert found == [(1, 1, 1), (1, 1, 2), (1, 2, 2)]
    assert ls.search(docs.limit(0), items).count() == 0
    assert ls.search(docs, items.limit(0)).count() == 0
