"""The chained stages against the same steps done one document at a time."""

import hashlib

import corpus_pipeline
from firstseen.llm import quality, queries, source_mix
from tests.llm.test_simhash import model as simhash_model

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = queries.read(spark, SF, "documents")
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    fitted = queries.quality_model(spark, SF, docs)
    import numpy as np

    good = {i for i, r in rows.items() if fitted.score(np.frombuffer((r["text"] or "").encode(), np.uint8)) >= 0.3}
    last = {}
    for i in sorted(good):
        last[rows[i]["text"] or ""] = i
    near = simhash_model([(i, rows[i]["text"]) for i in sorted(last.values())])
    left = sorted(i for i, _, component in near if i == component)
    remaining = spark.createDataFrame([tuple(rows[i].values()) for i in left], docs.schema)
    want = {r.doc_id: r.copies for r in source_mix.mix(remaining).collect() if r.copies}
    result = corpus_pipeline.run(spark, SF).collect()
    got = {}
    for r in result:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert r.decoded_sha256 == hashlib.sha256((rows[r.doc_id]["text"] or "").encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() and len(r.ids) == 4 * r.n_tokens
    assert got == want


def test_stages_keep_columns(spark):
    docs = queries.read(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "encode"]
    assert quality.SAMPLE == 4_000
