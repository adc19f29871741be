"""One query per operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firstseen.llm import (
    bpe, exact_dedup, language, lexical_search, line_templates, quality, secret_scan, simhash, source_mix, spelling, substring_dedup,
    url_filter, vector_dedup,
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = exact_dedup.decisions(read(spark, sf_dir, "documents"))
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = source_mix.mix(read(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = """
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size
  FROM documents
), ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, 2 * source_size AS capacity,
         1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM ranked
), shared AS (
  SELECT *, weight * (budget - coalesce(sum(capacity) OVER (filled ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (filled ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= capacity AS capped
  FROM weighed WINDOW filled AS (ORDER BY capacity / weight, place)
), wanted AS (
  SELECT source, place, source_size, budget, CASE WHEN capped THEN capacity::DOUBLE ELSE
         weight * (budget - coalesce(sum(capacity) FILTER (capped) OVER (), 0)) / sum(weight) FILTER (NOT capped) OVER ()
         END AS target
  FROM shared
), timed AS (
  SELECT s.*, place, source_size, target, budget,
         sum(size) OVER (PARTITION BY s.source ORDER BY key ROWS UNBOUNDED PRECEDING) AS cumulative
  FROM sized s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source
), copies AS (
  SELECT *, CASE WHEN target > 0 THEN (source_size * copy + cumulative)::DOUBLE / target END AS finish
  FROM timed, (VALUES (0), (1)) c(copy)
), cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, place, copy, key ROWS UNBOUNDED PRECEDING) <= budget AS fits
  FROM copies
)
SELECT doc_id, size::BIGINT AS size, source_size, target, sum(CASE WHEN fits THEN size ELSE 0 END)::BIGINT AS taken
FROM cut GROUP BY doc_id, key, source, size, source_size, target
"""


# Fixed values of the derived capture and list times: start, steps and span in seconds.
T0, CAPTURE_STEP, LIST_STEP, SPAN = 1_700_000_000, 43_201, 104_729, 12_960_000
# Hosts with these names come onto the derived list, as domains.
LISTED = "(spam-farm|cheap-pills|free-bets|adult-x)[.].*"


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, with a fetch time derived from its id."""
    fetched = F.lit(T0) + (F.col("page_id") * CAPTURE_STEP) % SPAN
    return read(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_at"))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dated list derived from the pages: each page of a listed host adds or removes
    its domain, each page linked to with a fragment adds or removes itself."""
    url = F.col("url")
    domain = F.concat(F.lit("domain:"), F.regexp_extract(url_filter.host(url), LISTED, 0))
    page = F.concat(F.lit("url:"), url_filter.host(url), url_filter.path(url))
    rule = F.when(url_filter.host(url).rlike(LISTED), domain).when(url.endswith("#top"), page)
    action = F.when(F.col("page_id") % 3 == 0, "remove").otherwise("add")
    at = F.lit(T0) + (F.col("page_id") * LIST_STEP) % SPAN
    return read(spark, sf_dir, "pages").select(rule.alias("rule"), action.alias("action"), at.alias("at"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.evaluate(captures(spark, sf_dir), list_entries(spark, sf_dir))


OP3_SQL = """
WITH parsed AS (
  SELECT page_id, url, 1700000000 + (page_id * 43201) % 12960000 AS fetched_at,
         lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host,
         regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS path
  FROM pages
), entries AS (
  SELECT CASE WHEN regexp_matches(host, '(spam-farm|cheap-pills|free-bets|adult-x)[.]')
              THEN 'domain:' || regexp_extract(host, '(spam-farm|cheap-pills|free-bets|adult-x)[.].*', 0)
              WHEN url LIKE '%#top' THEN 'url:' || host || path END AS rule,
         page_id % 3 = 0 AS removed, 1700000000 + (page_id * 104729) % 12960000 AS listed_at
  FROM parsed
), dated AS (
  SELECT rule, listed_at, bool_or(removed) AS removed FROM entries WHERE rule IS NOT NULL GROUP BY rule, listed_at
), valid AS (
  SELECT rule, listed_at AS since, lead(listed_at) OVER (PARTITION BY rule ORDER BY listed_at) AS until, removed FROM dated
), asked AS (
  SELECT page_id, fetched_at, unnest(
    [ 'domain:' || array_to_string(string_split(host, '.')[i:], '.') FOR i IN range(1, len(string_split(host, '.'))) ]
    || [ 'url:' || host || path ]) AS rule
  FROM parsed
), hits AS (
  SELECT page_id, min({'l': -length(v.rule), 'rule': v.rule, 'since': since}) AS hit
  FROM asked a JOIN valid v ON a.rule = v.rule AND fetched_at >= since AND (until IS NULL OR fetched_at < until) AND NOT removed
  GROUP BY page_id
)
SELECT p.page_id, url, fetched_at, hit IS NOT NULL AS rejected, hit.rule AS rule, hit.since AS since
FROM parsed p LEFT JOIN hits USING (page_id)
"""


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


THRESHOLD = 0.3


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality.Model:
    """Learned from the labels of documents that are not held out."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.fit(docs, labels.filter(~held_out(5, 0)))


def held_out(parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(spark, sf_dir, docs), F.col("doc_id"), held_out(5, 0).alias("held_out"))
    score = F.col("__score")
    return scored.select("doc_id", "held_out", score.alias("score"), F.when(score >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs.filter(~held_out(4, 2)))
    return language.predict(docs, model, F.col("doc_id"), held_out(4, 2).alias("held_out"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.dropped_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("dropped").alias("n_dropped"), F.array_join("dropped", ",").alias("dropped"))


def op10_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = tokenizer or public_tokenizer()
    encoded = bpe.encode(read(spark, sf_dir, "documents"), path, F.col("doc_id"), back=True)
    return encoded.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


OP11_SQL = """
WITH RECURSIVE steps AS (
  SELECT i::BIGINT AS byte, i::BIGINT AS crc, 0 AS bit FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, bit + 1 FROM steps WHERE bit < 8
), crcs AS (
  SELECT list(crc ORDER BY byte) AS crcs FROM steps WHERE bit = 8
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{00C0}-\\x{00FF}]+')) AS run
  FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS bytes FROM runs GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, len(bytes), 2), lambda i: ('0x' || substr(bytes, i, 2))::BIGINT)),
    lambda crc, byte: xor(crc >> 8, crcs[(xor(crc, byte) & 255) + 1]))) AS h
  FROM counted, crcs
), planted AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM planted WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), shorter AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM words
), cut AS (
  SELECT word, n, place, substr(word, 1, place - 1) || substr(word, place + 1) AS left_over FROM shorter
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.place = b.place AND a.left_over = b.left_over AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.left_over = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.left_over = w.word
), best AS (
  SELECT word, count(*) AS n_near, min({'less': -other_n, 'form': other}) AS best FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * w.n THEN best.form END AS form,
         CASE WHEN -best.less >= 2 * w.n THEN -best.less END AS form_n
  FROM words w LEFT JOIN best USING (word)
), chains AS (
  SELECT word, word AS root, form AS next, 0 AS depth FROM formed
  UNION ALL SELECT c.word, f.word, f.form, c.depth + 1 FROM chains c JOIN formed f ON c.next = f.word
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chains c ON c.word = f.word AND c.next IS NULL
"""


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", F.col("__words").alias("n_words"), F.col("__removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256")
    )


OP12_SQL = """
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 18)) AS start, words FROM split
), keyed AS (
  SELECT doc_id, start, array_to_string(words[start:start + 19], ' ') AS spelled FROM windows
), later AS (
  SELECT doc_id, start, row_number() OVER (PARTITION BY spelled ORDER BY doc_id, start) > 1 AS gone FROM keyed
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS place FROM later WHERE gone
), removed AS (
  SELECT doc_id, list(place) AS places FROM covered GROUP BY doc_id
), kept AS (
  SELECT doc_id, len(words) AS n_words, len(coalesce(places, [])) AS n_removed,
         CASE WHEN places IS NULL THEN words ELSE list_transform(
           list_filter(list_zip(words, range(1, len(words) + 1)), lambda w: NOT list_contains(places, w[2])), lambda w: w[1]) END AS words
  FROM split LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(words, ' ')) AS kept_sha256 FROM kept
"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


OP13_SQL = """
WITH held AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents
), counted AS (
  SELECT doc_id, term, count(*) AS tf FROM held GROUP BY doc_id, term
), sizes AS (
  SELECT doc_id, count(*) AS n FROM held GROUP BY doc_id
), totals AS (
  SELECT count(*) AS documents, sum(n)::BIGINT AS words FROM sizes
), weighed AS (
  SELECT term, floor(1000 * ln((2 * any_value(documents) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counted, totals GROUP BY term
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * documents) // words))))::BIGINT AS score
  FROM asked JOIN counted USING (term) JOIN weighed USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""


QUERIES = {
    query.__name__: query
    for query in (
        op1_exact_dedup, op2_source_mix, op3_url_filter, op4_secret_scan, op5_quality, op6_language_id, op7_vector_dedup,
        op8_simhash, op9_line_templates, op10_bpe, op11_spelling_variants, op12_substring_dedup, op13_lexical_search,
    )
}
ORACLES = {
    "op1_exact_dedup": OP1_SQL, "op2_source_mix": OP2_SQL, "op3_url_filter": OP3_SQL, "op11_spelling_variants": OP11_SQL,
    "op12_substring_dedup": OP12_SQL, "op13_lexical_search": OP13_SQL,
}
