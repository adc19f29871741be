"""Rules that name the last label of a host."""

from firstseen.llm import url_filter


def test_last_label(spark):
    captures = spark.createDataFrame([(1, "http://a.b.xxx/p", 5), (2, "http://xxx.org/", 5), (3, "http://localhost/", 5)], "page_id long, url string, fetched_at long")
    entries = spark.createDataFrame([("domain:xxx", "add", 0), ("domain:localhost", "add", 0)], "rule string, action string, at long")
    found = {r.page_id: r.rule for r in url_filter.evaluate(captures, entries).collect()}
    assert found == {1: "domain:xxx", 2: None, 3: "domain:localhost"}


def test_rules_that_all_captures_ask_for(spark, monkeypatch):
    """Hot rules: one is not listed and moves no lookup, one is listed and salted."""
    monkeypatch.setattr(url_filter, "SPREAD", 4)
    captures = spark.createDataFrame([(i, f"http://h{i % 5}.shop.com/p{i}", i) for i in range(200)], "page_id long, url string, fetched_at long")
    entries = spark.createDataFrame([("domain:shop.com", "add", 50), ("domain:shop.com", "remove", 120), ("url:h3.shop.com/p153", "add", 0)], "rule string, action string, at long")
    found = {r.page_id: (r.rejected, r.rule) for r in url_filter.evaluate(captures, entries).collect()}
    want = {i: (True, "domain:shop.com") if 50 <= i < 120 else (False, None) for i in range(200)} | {153: (True, "url:h3.shop.com/p153")}
    assert found == want
