"""SQL that computes the result of each query in ``queries`` independently."""

from __future__ import annotations

from firstseen.plans.binding import EARLIER_MS, NOW_MS, SPAN, STEP, T0

_FILES = f"""
files AS (
  SELECT doc_id, lang, source, text,
         '/source/' || CASE WHEN source = 'src7' THEN '.' ELSE '' END || source || '/' || lang || '/'
           || CASE WHEN n_chars % 10 = 0 THEN '.' ELSE '' END || CAST(doc_id AS VARCHAR)
           || CASE lang WHEN 'en' THEN '.txt' WHEN 'de' THEN '.TXT' ELSE '.Log' END AS path,
         CASE WHEN source = 'src7' THEN '.' ELSE '' END || source || '/' || lang || '/'
           || CASE WHEN n_chars % 10 = 0 THEN '.' ELSE '' END || CAST(doc_id AS VARCHAR)
           || CASE lang WHEN 'en' THEN '.txt' WHEN 'de' THEN '.TXT' ELSE '.Log' END AS rel_path,
         CAST(strlen(text) AS BIGINT) AS size,
         CAST(({T0} + (doc_id * {STEP}) % {SPAN}) * 1000000000 + n_chars AS BIGINT) AS mtime_ns,
         make_timestamp(({T0} + (doc_id * {STEP}) % {SPAN}) * 1000000) AS ts,
         sha256(text) AS content_hash
  FROM documents),
memory AS (
  SELECT DISTINCT content_hash FROM files JOIN labels USING (doc_id) WHERE quality = 1),
cache AS (
  SELECT path, size, CASE WHEN lang = 'fr' THEN mtime_ns - 1 ELSE mtime_ns END AS mtime_ns,
         CAST(0 AS BIGINT) AS ctime_ns, content_hash
  FROM files WHERE lang <> 'es')"""

_CLASSIFIED = _FILES + """,
classified AS (
  SELECT f.*, CASE WHEN c.path IS NULL THEN 'new'
                   WHEN c.size = f.size AND c.mtime_ns = f.mtime_ns AND c.ctime_ns = 0 THEN 'unchanged'
                   ELSE 'modified' END AS cache_result
  FROM files f LEFT JOIN cache c ON c.path = f.path)"""


def _decided(eligible: str) -> str:
    return _CLASSIFIED + f""",
placed AS (
  SELECT *, '/dest/' || year(ts) || '/' || month(ts) || '/' || day(ts) || '/' || rel_path AS dest_path,
         string_split(path, '/') AS pk, {eligible} AS eligible,
         content_hash IN (SELECT content_hash FROM memory) AS known
  FROM classified),
firsts AS (
  SELECT *, min(CASE WHEN eligible THEN pk END) OVER (PARTITION BY content_hash) AS wk FROM placed),
decided AS (
  SELECT *, CASE WHEN known THEN 'skipped' WHEN wk IS NULL OR pk < wk THEN 'failed'
                 WHEN pk = wk THEN 'copied' ELSE 'skipped' END AS outcome
  FROM firsts)"""


_FREE = _decided("lang <> 'de'")
_OVERRIDE = _decided("TRUE")
_EVENTS = """
files AS (
  SELECT '/source/' || event_type || '/' || CAST(event_id AS VARCHAR) AS path, event_type,
         sha256(props) AS content_hash, strlen(props) AS size
  FROM events)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"


def _counters(source: str) -> str:
    def pair(name: str, condition: str) -> str:
        return (
            f"CAST(count(*) FILTER (WHERE {condition}) AS BIGINT) AS {name}_files, "
            f"CAST(coalesce(sum(size) FILTER (WHERE {condition}), 0) AS BIGINT) AS {name}_bytes"
        )

    done = "outcome <> 'failed'"
    parts = [pair("total", done)]
    parts += [pair(v, f"{done} AND cache_result = '{v}'") for v in ("new", "modified", "unchanged")]
    parts += [pair(v, f"outcome = '{v}'") for v in ("copied", "skipped")]
    parts.append("CAST(count(*) FILTER (WHERE outcome = 'failed') AS BIGINT) AS failed_files")
    return f"SELECT {', '.join(parts)} FROM {source}"


_RANKED = """
SELECT {columns} FROM (
  SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY string_split(path, '/')) AS rn FROM files)
WHERE rn = 1"""

_GROUPS = """
SELECT content_hash, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes,
       array_to_string(min(string_split(path, '/')), '/') AS first_path
FROM files GROUP BY content_hash HAVING count(*) > 1"""

_CACHE_COLUMNS = "path, size, mtime_ns, ctime_ns, content_hash"

ORACLES: dict[str, str] = {
    "manifest_scan": _with(_FILES, "SELECT rel_path, size, mtime_ns FROM files"),
    "scan_globbed": _with(_FILES, r"""
        SELECT rel_path, size, mtime_ns FROM files
        WHERE lower(rel_path) LIKE '%.txt' AND NOT starts_with(source, 'src1') AND source <> 'src7'"""),
    "scan_directories": _with(_FILES, """
        SELECT CAST(1 + count(DISTINCT source) + count(DISTINCT source || '/' || lang) AS BIGINT) AS n_directories,
               CAST(0 AS BIGINT) AS n_errors FROM files"""),
    "ordered_scan": _with(_FILES, """
        SELECT path, CAST(row_number() OVER (
                 PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY string_split(path, '/')) AS BIGINT) AS position
        FROM files"""),
    "cached_paths": _with(_FILES, "SELECT path FROM cache"),
    "glob_include": _with(_FILES, "SELECT path, size FROM files WHERE lower(rel_path) LIKE '%.txt'"),
    "glob_exclude": _with(_FILES, r"""
        SELECT path, size FROM files
        WHERE lower(rel_path) NOT LIKE '%.txt' AND NOT regexp_matches(rel_path, '^src1[^/]/')"""),
    "glob_list": _with(_FILES, r"""
        SELECT path, size FROM files
        WHERE regexp_matches(rel_path, '^src[^/]*/(en|fr)/') AND NOT regexp_matches(rel_path, '(^|/)[0-4][^/]*$')"""),
    "ignore_hidden": _with(_FILES, r"SELECT path, size FROM files WHERE NOT regexp_matches(rel_path, '(^|/)\.')"),
    "absolute_path_check": r"""
        SELECT page_id, path, CASE WHEN starts_with(path, '/') THEN NULL ELSE 'path must be absolute' END AS error
        FROM (SELECT page_id, regexp_replace(url, '^https://[^/]*', '') AS path FROM pages)""",
    "file_metadata": _with(_FILES, """
        SELECT path, size, mtime_ns, CAST(0 AS BIGINT) AS ctime_ns, CAST(NULL AS VARCHAR) AS error FROM files"""),
    "content_digest": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "page_digest": r"""
        SELECT sha256('/source/' || CAST(page_id AS VARCHAR) || '/' || regexp_replace(url, '^https?://', '')) AS path_hash,
               sha256(html) AS content_hash, CAST(strlen(html) AS BIGINT) AS size FROM pages""",
    "path_digest": _with(_FILES, "SELECT path, sha256(path) AS path_hash FROM files"),
    "relative_path": _with(_FILES, """
        SELECT path, rel_path,
               CASE WHEN starts_with(path, '/source/src1/') THEN substr(path, 14) END AS rel_src1 FROM files"""),
    "classify_changes": _with(_CLASSIFIED, "SELECT path, size, cache_result FROM classified"),
    "no_cache_classify": _with(_FILES, "SELECT path, size, 'new' AS cache_result FROM files"),
    "incremental_hash": _with(_CLASSIFIED, "SELECT path, cache_result, content_hash FROM classified"),
    "unseen_content": _with(_FILES, """
        SELECT path, content_hash FROM files WHERE content_hash NOT IN (SELECT content_hash FROM memory)"""),
    "known_content": _with(_FILES, """
        SELECT path, content_hash FROM files WHERE content_hash IN (SELECT content_hash FROM memory)"""),
    "known_events": _with(_EVENTS, """
        SELECT path, content_hash IN (SELECT content_hash FROM files WHERE event_type = 'purchase') AS known
        FROM files"""),
    "seen_lookup": _with(_FILES, f"""
        SELECT path, CAST({EARLIER_MS} AS BIGINT) AS copied_time FROM files JOIN memory USING (content_hash)"""),
    "dest_conflicts": _with(_FREE, "SELECT dest_path, lang = 'de' AS dest_exists FROM placed"),
    "ingest_decision": _with(_FREE, "SELECT path, dest_path, outcome FROM decided"),
    "ingest_override": _with(_OVERRIDE, "SELECT path, dest_path, outcome FROM decided"),
    "failures": _with(_FREE, """
        SELECT path, 'destination already exists' AS error FROM decided WHERE outcome = 'failed'"""),
    "failures_globbed": """
        WITH keyed AS (
          SELECT CASE WHEN starts_with(url, 'https') THEN '/source/' ELSE '' END || page_id || '/' || url AS path,
                 starts_with(url, 'https') AS inside, sha256(html) AS content_hash
          FROM pages WHERE NOT starts_with(url, 'https') OR NOT starts_with(CAST(page_id AS VARCHAR), '1'))
        SELECT path, CASE WHEN NOT inside THEN 'failed' WHEN row_number() OVER (
                       PARTITION BY inside, content_hash ORDER BY string_split(path, '/')) = 1
                     THEN 'copied' ELSE 'skipped' END AS outcome,
               CASE WHEN NOT inside THEN 'path must be absolute' END AS error
        FROM keyed""",
    "failures_metadata": _with(_FILES, """
        SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'no modification time'
                          ELSE 'modification time is before 1970' END AS error
        FROM files WHERE doc_id % 5 = 0 OR doc_id % 3 = 0"""),
    "dedup_exact": _with(_FILES, _RANKED.format(columns="content_hash, path, size")),
    "dedup_events": _with(_EVENTS, _RANKED.format(columns="content_hash, path")),
    "decide_events": _with(_EVENTS, """
        SELECT path, CASE WHEN wk IS NULL OR pk < wk THEN 'failed' WHEN pk = wk THEN 'copied' ELSE 'skipped' END AS outcome
        FROM (SELECT path, pk, min(CASE WHEN event_type <> 'click' THEN pk END) OVER (PARTITION BY content_hash) AS wk
              FROM (SELECT *, string_split(path, '/') AS pk FROM files))"""),
    "duplicate_groups": _with(_FILES, _GROUPS),
    "duplicate_events": _with(_EVENTS, _GROUPS),
    "ingest_stats": _with(_FREE, _counters("decided")),
    "run_stats": _with(_FILES, _counters(
        "(SELECT size, 'unchanged' AS cache_result, 'skipped' AS outcome FROM files)")),
    "resume_stats": _with(_CLASSIFIED, _counters("""
        (SELECT *, CASE WHEN row_number() OVER (PARTITION BY content_hash ORDER BY string_split(path, '/')) = 1
                        THEN 'copied' ELSE 'skipped' END AS outcome FROM classified)""")),
    "cached_path_count": _with(_FILES, "SELECT CAST(count(*) AS BIGINT) AS cached_paths FROM cache"),
    "scan_counts": _with(_FILES, """
        SELECT CAST(sum(n) AS BIGINT) AS n_files, CAST(count(*) AS BIGINT) AS n_directories,
               CAST(sum(b) AS BIGINT) AS n_bytes, CAST(max(n) AS BIGINT) AS largest_directory_files
        FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS d, count(*) AS n, sum(size) AS b FROM files GROUP BY 1)"""),
    "cache_upsert": _with(_FILES, """
        SELECT path, size, mtime_ns, CAST(0 AS BIGINT) AS ctime_ns, content_hash FROM files"""),
    "cache_delete": _with(_FILES, f"""
        SELECT {_CACHE_COLUMNS} FROM cache WHERE path NOT IN (SELECT path FROM files WHERE lang = 'de')"""),
    "cache_cleanup": _with(_FILES, f"""
        SELECT {_CACHE_COLUMNS} FROM cache WHERE path IN (SELECT path FROM files WHERE lang <> 'en')"""),
    "cleanup_counts": _with(_FILES, """
        SELECT CAST(count(*) AS BIGINT) AS checked,
               CAST(count(*) FILTER (WHERE path IN (SELECT path FROM files WHERE lang = 'en')) AS BIGINT) AS removed
        FROM cache"""),
    "ledger_append": _with(_FILES, f"""
        SELECT content_hash, CAST({EARLIER_MS} AS BIGINT) AS copied_time, 'batch' AS writer, CAST(0 AS BIGINT) AS run_id
        FROM memory
        UNION ALL
        SELECT DISTINCT content_hash, CAST({NOW_MS} AS BIGINT), 'batch', CAST(1 AS BIGINT)
        FROM files WHERE content_hash NOT IN (SELECT content_hash FROM memory)"""),
    "ledger_forget": _with(_FILES, f"""
        SELECT content_hash, CAST({EARLIER_MS} AS BIGINT) AS copied_time FROM memory
        WHERE content_hash NOT IN (SELECT content_hash FROM files WHERE lang = 'en')"""),
    "ledger_compact": _with(_FILES, f"""
        SELECT DISTINCT content_hash,
               CAST(CASE WHEN content_hash IN (SELECT content_hash FROM memory)
                    THEN {EARLIER_MS} ELSE {NOW_MS} END AS BIGINT) AS copied_time, 'compact' AS writer
        FROM files"""),
    "load_seen": _with(_FILES, """
        SELECT DISTINCT content_hash, 'batch' AS writer, CAST(0 AS BIGINT) AS run_id FROM files"""),
    "load_then_ingest": _with(_FILES, """
        SELECT path, CASE WHEN lang = 'en' THEN 'unchanged' ELSE 'new' END AS cache_result,
               CASE WHEN rn = 1 AND content_hash NOT IN (SELECT content_hash FROM files WHERE lang = 'en')
                    THEN 'copied' ELSE 'skipped' END AS outcome
        FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY string_split(path, '/')) AS rn FROM files)
        """),
    "ledger_forget_then_compact": _with(_FILES, f"""
        SELECT content_hash, CAST(min(copied_time) AS BIGINT) AS copied_time, 'compact' AS writer FROM (
          SELECT content_hash, {EARLIER_MS} AS copied_time FROM memory
          WHERE content_hash NOT IN (SELECT content_hash FROM files WHERE lang = 'en')
          UNION ALL SELECT content_hash, {NOW_MS} FROM files WHERE lang = 'es')
        GROUP BY content_hash"""),
    "render_utc": """
        SELECT o_orderkey, 'out/' || year(o_orderdate) || '/' || year(o_orderdate) || '-' || month(o_orderdate)
                           || '-' || day(o_orderdate) || '/{YEAR_UTC}' AS rendered FROM orders""",
    "render_local": _with(_FILES, """
        SELECT path, 'out/' || year(l) || '/' || month(l) || '/' || day(l) AS rendered
        FROM (SELECT path, timezone('America/New_York', timezone('UTC', ts)) AS l FROM files)"""),
    "destination_path": _with(_FREE, "SELECT path, dest_path FROM placed"),
    "accepted_by_day": _with(_FREE, """
        SELECT doc_id, text, CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month,
               CAST(day(ts) AS BIGINT) AS day
        FROM decided WHERE outcome = 'copied'"""),
    "accepted_by_template": _with(_FILES, """
        SELECT doc_id, text, lang, source, n_chars, CAST(1815 + doc_id % 100 AS BIGINT) AS year,
               CAST(year(l) AS BIGINT) AS year_local, CAST(month(l) AS BIGINT) AS month_local
        FROM (SELECT f.*, d.n_chars, timezone('America/New_York', timezone('UTC', ts)) AS l,
                     row_number() OVER (PARTITION BY content_hash ORDER BY string_split(path, '/')) AS rn
              FROM files f JOIN (SELECT doc_id, n_chars FROM documents) d USING (doc_id))
        WHERE rn = 1"""),
    "copy_files": _with(_FILES, _RANKED.format(
        columns="year(ts) || '/' || month(ts) || '/' || day(ts) || '/' || rel_path AS rel_path, size, content_hash")),
    "override_files": _with(_FILES, """
        SELECT 'all/' || rel_path AS rel_path, CASE WHEN rn = 1 THEN size ELSE 0 END AS size,
               CASE WHEN rn = 1 THEN content_hash ELSE sha256('') END AS content_hash
        FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY string_split(path, '/')) AS rn FROM files)
        """),
    "cleanup_files": _with(_FILES, """
        SELECT rel_path, size, content_hash,
               (SELECT CAST(count(*) AS BIGINT) FROM files WHERE source = 'src1') AS removed
        FROM files WHERE source <> 'src1'"""),
    "stream_ingest": _with(_FILES, """
        SELECT content_hash, 'earlier' AS writer FROM memory
        UNION ALL
        SELECT DISTINCT content_hash, 'documents' FROM files
        WHERE content_hash NOT IN (SELECT content_hash FROM memory)"""),
    "stream_accepted": _with(_FILES, """
        SELECT DISTINCT text, 'documents' AS accepted_by FROM files
        WHERE content_hash NOT IN (SELECT content_hash FROM memory)"""),
    "stream_dedup": _with(_FILES, "SELECT DISTINCT content_hash FROM files"),
    "stream_tree": _with(_FILES, "SELECT rel_path, size, mtime_ns FROM files"),
    "stream_files": _with(_FILES, "SELECT DISTINCT size, content_hash FROM files"),
}
