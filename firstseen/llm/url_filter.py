"""URL filters by a temporal list join.

A list is a history of dated entries: at a time, a rule is added or removed. Per
rule, the entries become validity intervals, each lasting until the rule's next
entry. Every capture is looked up as of its fetch time: it is rejected by a rule
that matches its URL and whose interval holds that time. Rules name a domain with
all below it (``domain:``), a path with all below it (``prefix:``) or one page
(``url:``); a URL's candidate rules are computed, so the join is by equality.

A rule that more than 1 / SPREAD of all lookups ask for is hot, listed or not: fewer than
SPREAD rules can be, which bounds the broadcast of them. Lookups of a hot rule that no entry
names end there; those of a listed one are dealt out over as many salts as its share needs, its
intervals are copied to each. Interval
ends are found per rule and period first, so a rule with a long history does not
need one task.

Defined results. A null, blank or unparsable URL matches nothing, nor does a null
fetch time. Scheme, user, port, query and fragment are ignored; hosts are compared
in lower case. Entries with a null rule, time or action are ignored. Of entries
for one rule at one time a removal wins; repeated ones count once. Repeated
captures get equal results, in every row. Other columns are not read. With an empty
list nothing is rejected; with no captures the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firstseen.llm.common import located
from firstseen.workspace import stage

SPREAD = 1_000
PERIOD = 86_400 * 30  # seconds

_URL = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#\s]*)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, _URL, 2), "/+$", "")


def rules_for(url: Column) -> Column:
    """All rules that can match ``url``, as an array of strings."""
    name, there = host(url), path(url)
    labels = F.split(name, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    steps = F.split(there, "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda i: F.concat(F.lit("prefix:"), name, F.array_join(F.slice(steps, F.lit(1), i), "/")),
    )
    page = F.array(F.concat(F.lit("url:"), name, there))
    return F.when(name != "", F.array_distinct(F.concat(domains, prefixes, page)))


def intervals(entries: DataFrame) -> DataFrame:
    """(rule, since, until): when each rule is active; ``until`` null if it still is.

    ``entries`` has rule, action (``add`` or ``remove``) and at, a long.
    """
    valid = entries.filter(F.col("rule").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove"))
    dated = valid.groupBy("rule", "at").agg(F.max(F.col("action") == "remove").alias("removed"))
    dated = stage(dated.withColumn("period", F.floor(F.col("at") / PERIOD)), "list-entries")
    firsts = dated.groupBy("rule", "period").agg(F.min("at").alias("first"))
    later = F.lead("first").over(Window.partitionBy("rule").orderBy("period"))
    ahead = firsts.select("rule", "period", later.alias("later"))
    following = F.lead("at").over(Window.partitionBy("rule", "period").orderBy("at"))
    ended = dated.withColumn("following", following).join(ahead, ["rule", "period"])
    return ended.filter(~F.col("removed")).select(
        "rule", F.col("at").alias("since"), F.coalesce("following", "later").alias("until")
    )


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture (page_id, url, fetched_at): those, rejected, rule, since.

    ``rule`` is the longest rule that rejects it (the first in order, of equal
    lengths), ``since`` the start of its interval.
    """
    rows = stage(located(captures, "page_id", "url", "fetched_at"), "captures")
    asked = rows.select("file", "row", "fetched_at", F.explode(rules_for(F.col("url"))).alias("rule"))
    asked = asked.filter("fetched_at is not null")
    active = stage(intervals(entries), "list-intervals")
    # Rules are counted, combining before the shuffle, before any lookup moves.
    counts = stage(asked.groupBy("rule").agg(F.count(F.lit(1)).alias("n")), "rule-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    salts = F.ceil(F.col("n") * SPREAD / F.lit(max(total, 1))).cast("int").alias("salts")
    often = counts.filter(F.col("n") * SPREAD > total).select("rule", salts)
    listed = active.join(F.broadcast(often), "rule", "left_semi").select("rule", F.lit(True).alias("listed")).distinct()
    hot = stage(often.join(listed, "rule", "left"), "hot-rules")
    spread = F.coalesce("salts", F.lit(1))
    met = asked.join(F.broadcast(hot), "rule", "left").filter("salts is null or listed")
    salted = met.select("rule", "file", "row", "fetched_at", F.pmod(F.xxhash64("file", "row"), spread).cast("int").alias("salt"))
    copied = active.join(F.broadcast(hot), "rule", "left").select(
        "rule", "since", "until", F.explode(F.sequence(F.lit(0), spread - 1)).alias("salt")
    )
    at = F.col("fetched_at")
    holds = (at >= F.col("since")) & (F.col("until").isNull() | (at < F.col("until")))
    met = salted.join(copied, ["rule", "salt"]).filter(holds)
    order = F.struct((-F.length("rule")).alias("l"), "rule", "since")
    hits = met.groupBy("file", "row").agg(F.min(order).alias("hit"))
    return rows.join(hits, ["file", "row"], "left").select(
        "page_id", "url", "fetched_at", F.col("hit").isNotNull().alias("rejected"), F.col("hit.rule").alias("rule"), F.col("hit.since").alias("since")
    )
