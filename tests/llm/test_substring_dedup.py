"""Substring dedup against a model that looks up every window."""

import random
import re

import pytest

from firstseen.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string"


def model(texts):
    """For texts in order: number of words, number removed, words kept."""
    seen, out = set(), []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - sd.WINDOW + 1):
            window = tuple(words[i : i + sd.WINDOW])
            if window in seen:
                gone.update(range(i, i + sd.WINDOW))
            seen.add(window)
        out.append((len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def check(spark, rows, schema=SCHEMA):
    kept = sd.without_repeats(spark.createDataFrame(rows, schema))
    found = sorted(
        (r["doc_id"], r["__words"], r["__removed"], r["text"]) for r in kept.collect()
    )
    ordered = sorted(rows)
    assert found == [(row[0], *facts) for row, facts in zip(ordered, model([row[1] for row in ordered]))]
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_passages(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [passage(n) for n in (19, 20, 21, 26, 33, 60, 200)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += passage(rng.randint(0, 25))
            text = rng.choice(shared)
            at = rng.randint(0, max(0, len(text) - 22))
            parts += text[at : at + rng.randint(15, 70)]
        rows.append((i - 20, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(100, None), (101, ""), (102, "  \n "), (103, rows[5][1]), (104, rows[5][1]), (105, "again and " * 50), (106, " 　 é " * 30)]
    found = check(spark, rows)
    assert any(0 < r[2] < r[1] for r in found) and any(r[2] == r[1] > 0 for r in found)


def test_pieces_and_a_passage_in_every_document(spark, monkeypatch):
    monkeypatch.setattr(sd, "_PIECE", 7)
    monkeypatch.setattr(sd, "SHARE", 2)
    long = " ".join(f"x{i % 977}" for i in range(5000))
    footer = " ".join(f"f{i}" for i in range(30))
    rows = [(0, long)] + [(i, f"own {i} {'text ' * 3}{footer} {i}") for i in range(1, 40)] + [(50, long[:6000])]
    check(spark, rows)


def test_ids_null_and_repeated_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(None, text, 1, "a"), (3, text, 2, "b"), (3, text, 3, "c"), (9, "short", 4, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, order long, file string").coalesce(1)
    kept = sd.without_repeats(docs)
    assert kept.columns == [*docs.columns, "__words", "__removed"]
    found = sorted((r["file"], r["__removed"]) for r in kept.collect())
    assert found == [("a", 25), ("b", 0), ("c", 25), ("d", 0)]
    assert sd.without_repeats(docs.limit(0)).count() == 0


def test_cover():
    for i in range(sd.PERIOD):
        for j in range(sd.PERIOD):
            assert any((i + d) % sd.PERIOD in sd.COVER and (j + d) % sd.PERIOD in sd.COVER for d in range(sd.PERIOD))
    for n in range(100):
        places = [p for p in range(max(0, n - sd.ANCHOR + 1)) if p % sd.PERIOD in sd.COVER] if n >= sd.WINDOW else []
        assert sd.n_anchors(n) == len(places) and sd.cover_places(0, len(places)).tolist() == places
