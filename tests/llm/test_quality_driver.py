"""Training the quality model: the driver gets the model, not the sample."""

import numpy as np

from firstseen.llm import quality


def test_driver_gets_the_model_alone(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 10**9, 400))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, label int")
    moved = []
    for name in ("collect", "toLocalIterator"):
        real = getattr(type(docs), name)

        def counted(frame, *args, real=real):
            rows = list(real(frame, *args))
            moved.extend(len(value) for row in rows for value in row if isinstance(value, bytes | bytearray | str))
            return rows

        monkeypatch.setattr(type(docs), name, counted)
    fitted = quality.fit(docs, labels)
    assert sum(moved) <= 4 * quality.FEATURES  # the weights
    rows = []
    for i, text in enumerate(texts):
        n = quality.counts(np.frombuffer(text.encode(), np.uint8))
        at = np.flatnonzero(n)
        rows.append((i % 2, at.astype("<i4").tobytes(), n[at].astype("<f4").tobytes()))
    assert sum(len(at) + len(n) for _, at, n in rows) > 10 * sum(moved)
    want = quality.train([(label, np.frombuffer(at, "<i4"), np.frombuffer(n, "<f4").astype(float)) for label, at, n in sorted(rows)])
    assert np.array_equal(fitted.weights, want.weights) and fitted.bias == want.bias
