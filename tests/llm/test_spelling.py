"""Spelling variants against a model that compares all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from firstseen.llm import spelling

SCHEMA = "doc_id long, text string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def model(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    form, n_near = {}, {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        n_near[w] = len(others)
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 2 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, n_near[w], words.get(form[w])) for w, n in words.items()}


def texts(seed, letters, n_docs=40):
    rng = random.Random(seed)
    lexicon = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(150)]
    weights = [1 / (i + 1) for i in range(len(lexicon))]
    return [(i, " ".join(w.title() if rng.random() < 0.2 else w for w in rng.choices(lexicon, weights, k=120))) for i in range(n_docs)]


@pytest.mark.parametrize("letters, piece", [("abé", spelling.PIECE), ("abé", 6), ("abcdefghÀ×", spelling.PIECE)])
def test_random_texts(spark, letters, piece):
    rows = texts(3, letters) + [(None, "solo solos solos solos"), (7, None), (8, "")] + texts(3, letters)[:5]
    found = [tuple(r) for r in spelling.variants(spark.createDataFrame(rows, SCHEMA), piece).collect()]
    want = model(rows)
    assert len(found) == len(want) and set(found) == want
    if len(letters) == 3:  # forms, and chains of them
        assert any(r[1] for r in want) and any(r[2] != r[1] and r[1] for r in want)


def test_index_names_every_near_word():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(4, 7))) for _ in range(300)})
    index = spelling.Index(words, set("abcd"))
    for length in range(5, 8):
        patterns = [w for w in words if len(w) == length] + ["d" * length]
        half, met = length // 2, set()
        for way in (0, 1):
            who, what = index.near(index.code(patterns), way)
            pairs = {(patterns[a], words[b]) for a, b in zip(who.tolist(), what.tolist())}
            same = lambda a, b: a[:half] == b[:half] if way else a[half:] == b[len(b) - len(a) + half :]  # noqa: B023, E731
            assert pairs == {(a, b) for a in patterns for b in words if near(a, b) and same(a, b)}
            met |= pairs
        assert met == {(a, b) for a in patterns for b in words if near(a, b)}


def test_suffixes():
    text = np.array([2, 3, 2, 3, 2, 2, 3, 1, 0])
    order = spelling._suffixes(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_empty_table_long_text_and_other_columns(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert spelling.variants(docs).count() == 0
    rows = [(1, "letters " * 50_000 + "lettters " * 4, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, word string")
    found = {r.word: (r.form, r.n) for r in spelling.variants(docs).collect()}
    assert found == {"letters": (None, 50_000), "lettters": ("letters", 4)}
