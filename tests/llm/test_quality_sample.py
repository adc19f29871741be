"""The sample of the quality model: at most so many documents, one for each id and label."""

import numpy as np

from firstseen.llm import quality


def test_repeated_ids_are_drawn_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows: seen.append(rows) or quality.Model(np.zeros(quality.FEATURES, np.float32), 0.0))
    docs = spark.createDataFrame([(7, f"copy {i}") for i in range(50)] + [(i, "a b") for i in range(100, 110)], "doc_id long, text string")
    labels = [(7, 1), (7, 1), *((i, 0) for i in range(100, 110)), *((i, 0) for i in range(1000, 1500))]
    labels = spark.createDataFrame(labels, "doc_id long, label int")
    quality.fit(docs, labels)
    quality.fit(docs, labels, 8)
    assert sorted(label for label, _, _ in seen[0]) == [0] * 10 + [1] and len(seen[1]) == 8
