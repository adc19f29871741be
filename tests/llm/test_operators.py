"""Edge cases and small models of the remaining operators."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from firstseen.llm import exact_dedup, language, quality, queries, secret_scan, source_mix, url_filter, vector_dedup

DOCS = "doc_id long, text string, source string, digest string, file int, size string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, text, source, "x", 1, "y") for i, text, source in rows], DOCS)


def test_exact_dedup(spark):
    rows = [(1, "a", "s"), (7, "a", "s"), (7, "a", "s"), (2, None, "s"), (3, "", "s"), (None, "b", "s"), (None, "b", "s"), (4, "A", "s"), (5, "z" * 3_000_000, "s")]
    docs = docs_of(spark, rows)
    weak = lambda text: F.substring(F.unhex(F.sha2(text, 256)), 1, 0)  # noqa: E731  every text hits
    for digest in (exact_dedup.sha256, weak):
        found = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.decisions(docs, digest).collect())
        assert found == [(0, 0, 2, False), (0, 0, 2, True), (1, 7, 3, False), (2, 3, 2, False), (3, 3, 2, True), (4, 4, 1, True), (5, 5, 1, True), (7, 7, 3, False), (7, 7, 3, True)]
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 5, 7]
    assert exact_dedup.decisions(docs.limit(0)).count() == 0


def test_state_goes_on_after_more_arrivals(spark):
    from firstseen.workspace import fresh_folder

    folder = fresh_folder(spark, "test-state")
    for batch in ([(1, "a", "s"), (2, "b", "s")], [(3, "a", "s")]):
        exact_dedup.arrivals_of(docs_of(spark, batch)).write.mode("append").parquet(f"{folder}/in")
        schema = spark.read.parquet(f"{folder}/in").schema
        state = exact_dedup.run_state(spark, f"{folder}/in", schema, f"{folder}/state").collect()
    assert sorted((r.keep.doc_id, r.group_size) for r in state) == [(2, 1), (3, 2)]


def test_source_mix(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 4}") for i in range(400)] + [(None, None, None), (900, "x y", None), (901, " ", "s0")]
    found = source_mix.mix(docs_of(spark, rows)).collect()
    assert len(found) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in found)
    per = {}
    for r in found:
        per.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    for (size, target), taken in per.items():
        assert target <= 2 * size and abs(sum(taken) - target) <= 12
    again = source_mix.mix(docs_of(spark, rows)).collect()
    by_id = lambda rows: sorted((r.doc_id or -1, r.taken) for r in rows)
    assert by_id(found) == by_id(again)
    assert source_mix.mixed(docs_of(spark, rows)).columns == docs_of(spark, rows).columns
    assert source_mix.mix(docs_of(spark, []).limit(0)).count() == 0
    assert [r.taken for r in source_mix.mix(docs_of(spark, [(1, None, "s")])).collect()] == [0]


def test_url_filter(spark):
    captures = spark.createDataFrame(
        [(1, "http://u@Spam.example.com:80/a/b?q#f", 5), (2, "https://spam.example.com/a/b", 25), (3, None, 5), (4, "nonsense", 5),
         (5, "http://x.org/p/q/", 10), (6, "http://x.org/p/qq", 10), (7, "http://x.org/p/q", None), (5, "http://x.org/p/q/", 10)],
        "page_id long, url string, fetched_at long")
    entries = spark.createDataFrame(
        [("domain:example.com", "add", 0), ("domain:example.com", "remove", 20), ("domain:example.com", "add", 30), ("prefix:x.org/p/q", "add", 10),
         ("prefix:x.org/p/q", "add", 10), (None, "add", 1), ("url:x.org/p/q", "add", 10), ("url:x.org/p/q", "remove", 10)],
        "rule string, action string, at long")
    found = sorted((r.page_id, r.rejected, r.rule) for r in url_filter.evaluate(captures, entries).collect())
    assert found == [(1, True, "domain:example.com"), (2, False, None), (3, False, None), (4, False, None), (5, True, "prefix:x.org/p/q"),
                     (5, True, "prefix:x.org/p/q"), (6, False, None), (7, False, None)]
    assert url_filter.evaluate(captures, entries.limit(0)).filter("rejected").count() == 0
    assert url_filter.evaluate(captures.limit(0), entries).count() == 0


def base_model(text):
    kinds = (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16))
    found = []
    for k, (name, pattern, flags, least) in enumerate(kinds):
        for m in re.compile(pattern, flags).finditer(text):
            if len(m[2] if name == "assign" else m[0]) >= least:
                found.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(found))


def test_secret_scan(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in queries.read(spark, folder, "documents").select("doc_id", "text").collect()}
    for r in queries.op4_secret_scan(spark, folder).collect():
        base = base_model(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(base.count(k + ":") for k in ("assign", "access", "hex"))
    odd = "é Api_Key : 'abcdefghijkl' ſecret=abcdefghijklmn PASSWORD=short tokentoken=abcdefabcdefabcdef0"
    base, _ = secret_scan.spans(odd)
    assert secret_scan._spell(base) == base_model(odd)
    code = 'part = "Xk9" + "fQ27vLm4Zt8"\nclient_credential = part\nname = "plain words"\nuser_id: 1234567890abcde'
    assert [code[s:e] for s, e, _ in secret_scan.spans(code)[1]] == ['Xk9" + "fQ27vLm4Zt8']
    assert secret_scan.spans(None) == ([], [])
    nulls = docs_of(spark, [(None, None, "s"), (1, "", "s")])
    assert [r.spans for r in secret_scan.scan(nulls).collect()] == ["", ""] and secret_scan.scan(nulls.limit(0)).count() == 0


def test_quality(spark):
    found = queries.op5_quality(spark, "/root/testdata/sf0.1").filter("held_out")
    labels = queries.read(spark, "/root/testdata/sf0.1", "labels")
    right = found.join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.97
    text = "ab cde ab\tfé " * 5
    raw = np.frombuffer(text.encode(), np.uint8)
    many = np.tile(raw, 60_000)
    assert quality.counts(many).sum() >= 59_000 * quality.counts(raw).sum() - 60_000
    docs = docs_of(spark, [(1, None, "s"), (None, "", "s"), (2, "a", "s")])
    nothing = quality.fit(docs, spark.createDataFrame([(9, None)], "doc_id long, label int"))
    assert {r["__score"] for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.good(docs, nothing, 0.3).columns == docs.columns and quality.good(docs.limit(0), nothing, 0.3).count() == 0


def test_language(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.op6_language_id(spark, folder).join(queries.read(spark, folder, "documents"), "doc_id").filter("held_out")
    assert found.count() > 200 and found.filter("lang_pred <> lang").count() == 0
    docs = spark.createDataFrame([(1, "the cat", "en"), (2, "der hund", "de"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    tried = spark.createDataFrame([(1, "The!"), (2, "hunde"), (3, None), (4, "12 ..."), (None, "日本")], "doc_id long, text string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(tried, model, F.col("doc_id")).collect()}
    assert [out[i][0] for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"] and out[None][0] in ("de", "en") and out[3][1] == 0
    empty = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.predict(tried, empty, F.col("doc_id")).collect()} == {"und"}
    grams = language.gram_counts({"ab": 2, "a": 1, "abcd": 1})
    for length in range(1, 5):
        want = {}
        for word, n in (("ab", 2), ("a", 1), ("abcd", 1)):
            for gram in language.grams_of(word, length):
                want[gram] = want.get(gram, 0) + n
        assert dict(grams[length]) == want


def test_vector_dedup(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((120, 24))
    near = x[:40] + 0.28 * rng.standard_normal((40, 24))
    crowd = x[0] + 0.2 * rng.standard_normal((60, 24))
    rows = [(i, v.tolist(), "z") for i, v in enumerate(np.concatenate([x, near, crowd, x[:5] * 3, x[:5]]))]
    odd = [(1000, None, "z"), (1001, [], "z"), (1002, [0.0] * 24, "z"), (1003, [float("nan")] * 24, "z"), (1004, [None] * 24, "z"), (1005, [1.0], "z"), (1006, [2.0], "z")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, key string")
    v = np.array([r[1] for r in rows])
    cos = (v @ v.T) / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1)) >= 0.9
    a, b = np.nonzero(cos)
    labels = vector_dedup._merge(np.arange(len(v)), a, b)
    want = {i: (int(cos[i].sum()) - 1, int(labels[i]), int(labels[i]) == i) for i in range(len(v))}
    want |= {i: (0, i, True) for i in range(1000, 1005)} | {1005: (1, 1005, True), 1006: (1, 1005, False)}
    for size in (8192, 32):
        monkeypatch.setattr(vector_dedup, "CELL_ROWS", size)
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(table).collect()} == want
    assert vector_dedup.near_duplicates(table.limit(0)).count() == 0
