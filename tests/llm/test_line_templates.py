"""Line templates against a model that walks the tree document by document."""

import random
from collections import Counter, defaultdict

from firstseen.llm import line_templates as lt


def model(texts, documents=lt.DOCUMENTS, keep=lt.KEEP):
    """Line numbers to drop per text, after the docstring: every rule looks up whole lines, documents are sets."""
    parsed = [[(tuple(x.split()), tuple(lt.tokens_of(x))) for x in text.split("\n")] if text else [] for text in texts]
    raw, masked, words = defaultdict(set), defaultdict(set), {}
    for doc, lines in enumerate(parsed):
        for tokens, general in lines:
            if tokens:
                raw[tokens].add(doc)
            if len(tokens) >= lt.TOKENS:
                masked[general].add(doc)
                words[tokens] = general
    share = lambda general: 1 - general.count("<*>") / len(general)
    drop = {t for t, docs in raw.items() if len(t) < lt.TOKENS and len(docs) >= documents}  # short lines as they stand
    drop |= {t for t, g in words.items() if share(g) >= keep and len(masked[g]) >= documents}  # digits aside
    drop |= {t for t, g in words.items() if share(g) < keep and len(raw[t]) >= documents}  # digits included
    drop |= {t for t in words if len(t) >= lt.LONG and len({texts[doc] for doc in raw[t]}) > 1}  # passages
    # Templates: fields of a leaf with enough lines stay constant, documents are counted once.
    leaves, support, held = defaultdict(set), Counter(), defaultdict(set)
    leaf = lambda g: (len(g), g[: lt.DEPTH])
    for g, docs in masked.items():
        leaves[leaf(g)].add(g)
        support.update({(leaf(g), i, token): len(docs) for i, token in enumerate(g)})
    pattern = {}
    for g, docs in masked.items():
        fixed = [token != "<*>" and support[leaf(g), i, token] >= documents for i, token in enumerate(g)]
        if sum(fixed) / len(g) >= keep and len(leaves[leaf(g)]) > 1:
            pattern[g] = (leaf(g), tuple(token if f else None for token, f in zip(g, fixed)))
            held[pattern[g]] |= docs
    drop |= {t for t, g in words.items() if g in pattern and len(held[pattern[g]]) >= documents}
    return [[i for i, (tokens, _) in enumerate(lines) if tokens in drop] for lines in parsed]


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_lines, r.dropped) for r in lt.dropped_lines(docs).collect()}
    want = model(texts)
    assert found == {i: (len(t.split("\n")) if t else 0, w) for i, (t, w) in enumerate(zip(texts, want))}
    return want


def test_random_documents(spark):
    rng = random.Random(2)
    words = [f"w{chr(97 + i)}" for i in range(12)]
    fields = lambda: f"login of the user {rng.choice(words)}{rng.choice(words)} from host {rng.randint(1, 99)} at the main gate today"
    texts = []
    for i in range(60):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(6)]
        if i % 2:
            lines.insert(rng.randint(0, 6), fields())
        if i % 3 == 0:
            lines += ["All rights reserved by the authors.", "", "  "]
        texts.append("\n".join(lines))
    texts += [None, "", texts[0], texts[0], "x " * 100_000]
    want = check(spark, texts)
    assert all(want[i] for i in range(1, 60, 2))  # the logged lines differ in two fields and are all dropped
    assert not check(spark, ["one two three four five six", "seven eight nine ten eleven"])[0]


def test_whole_table(spark):
    from firstseen.llm import queries

    folder = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in queries.read(spark, folder, "documents").select("doc_id", "text").collect())
    found = {r.doc_id: r.dropped for r in queries.op9_line_templates(spark, folder).collect()}
    assert found == {i: ",".join(map(str, w)) for (i, _), w in zip(rows, model([t for _, t in rows]))}


def test_texts_empty_table_and_clashing_columns(spark):
    line = "the same long line again and again"
    docs = spark.createDataFrame([(None, f"{line}\nown words {i}", 1, "n") for i in range(12)], "doc_id long, text string, leaf int, number string")
    kept = lt.without_recurring_lines(docs)
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.collect()) == sorted(f"own words {i}" for i in range(12))
    assert lt.dropped_lines(docs.limit(0)).count() == 0
