"""Embedding near-dedup: vectors are stored once, whatever they are compared to."""

import numpy as np
from pyspark.sql import functions as F

from firstseen.llm import vector_dedup


def brute(vectors):
    """{row: (n_links, component)} of vectors, by the exact expression in double precision."""
    n = len(vectors)
    linked = np.eye(n, dtype=bool)
    for dim in {len(v) for v in vectors}:
        at = np.array([i for i, v in enumerate(vectors) if len(v) == dim])
        x = vector_dedup.unit(np.array([vectors[i] for i in at], "<f8"))
        for i, row in zip(at, x):
            linked[i, at] |= (row * x).sum(1) >= vector_dedup.COSINE
    root = np.arange(n)
    while not np.array_equal(nearer := np.array([root[row].min() for row in linked]), root):
        root = nearer
    return {i: (int(linked[i].sum()) - 1, int(root[i])) for i in range(n)}


def found(table):
    return {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(table).collect()}


def test_comparing_shuffles_no_vectors(spark, monkeypatch):
    plans = {}
    real = vector_dedup.stage

    def staged(df, label, *args):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, label, *args)

    monkeypatch.setattr(vector_dedup, "stage", staged)
    monkeypatch.setattr(vector_dedup, "CELL_ROWS", 50)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((500, 64)).astype("<f4")
    vectors = [*x.tolist(), *(x[:60] + 0.3 * rng.standard_normal((60, 64)).astype("<f4")).tolist()]
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(6)
    kept = {i: tuple(r) for i, r in brute([np.array(v, "<f4") for v in vectors]).items()}
    assert found(table) == kept and sum(n > 0 for n, _ in kept.values()) >= 100
    assert "Exchange" not in plans["vector-links"]


def test_lengths_precisions_and_the_limit(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CELL_ROWS", 7)
    rng = np.random.default_rng(9)
    vectors = []
    for dim in (1, 2, 5, 20, 33):
        x = rng.standard_normal((12, dim))
        vectors += [*x, *x.astype("<f4").astype("<f8"), *(x * (1 + 1e-3 * rng.standard_normal(x.shape))), x[0] * 1e300, x[1] * 1e-42]
    for last in range(9, 20):  # nine of ten ones in common: the cosine is the limit, but for rounding
        one = np.zeros(20)
        one[[*range(9), last]] = 1
        vectors += [one, one * 0.1]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    assert found(table) == brute(vectors)


def test_chunks_hold_each_class_once(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CELL_ROWS", 9)
    monkeypatch.setattr(vector_dedup, "CHUNK_BYTES", 64)
    rows = [(bytes([i]) * 16, i, 1 + i % 5, bytes(4 * (1 + i % 5) * (1 + i % 2))) for i in range(200)]
    chunks = vector_dedup.chunked(spark.createDataFrame(rows, "key binary, n long, dim int, vector binary")).collect()
    held = [(c["keys"][16 * k : 16 * k + 16], int(n), c["dim"], c["vectors"][k * size : k * size + size])
            for c in chunks for size in [c["dim"] * (8 if c["wide"] else 4)] for k, n in enumerate(np.frombuffer(c["counts"], "<i8"))]
    assert sorted((bytes(k), n, d, bytes(v)) for k, n, d, v in held) == sorted(rows)
    assert len({c["id"] for c in chunks}) == len(chunks)
    for c in chunks:
        size = c["dim"] * (8 if c["wide"] else 4)
        assert len(c["vectors"]) < 64 + size and len(c["counts"]) <= 9 * 8


def test_each_pair_of_chunks_meets_once(spark):
    chunks = spark.range(40).select(F.lit(3).alias("dim"), "id")
    met = vector_dedup.meetings(chunks).select("id", "id2").collect()
    assert sorted(tuple(sorted(pair)) for pair in met) == [(a, b) for a in range(40) for b in range(a, 40)]
    assert min(sum(a == k for a, _ in met) for k in range(40)) >= 8  # not the last ones alone


def test_bound_is_never_below_the_cosine():
    rng = np.random.default_rng(10)
    for dim in (1, 2, 3, 64, 300):
        for cosine in (0.3, 0.9, 0.99):
            x = vector_dedup.unit(rng.standard_normal((80, dim)) * 10.0 ** rng.integers(-3, 3, (80, dim)))
            y = vector_dedup.unit(x + 0.1 * rng.standard_normal((80, dim)))
            turn = vector_dedup.rotation(dim)[:, : vector_dedup.leading(dim, cosine)]
            bound = vector_dedup.bounding(x, turn) @ vector_dedup.bounding(y, turn).T
            assert (bound.astype(float) >= x @ y.T - (dim + 16) * 2.0**-23).all()
