"""One query per operator over its whole table, and the SQL that must give the same rows."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (
    conversation_repair, decontaminate, language_id, line_winnow, metric_search, ngram_join, packing, quality_cascade,
    substring_dedup, token_counts, url_filter, warc, whitening,
)
from .common import NO_SPACE, table

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WORDS_SQL = """list_filter(string_split(translate(coalesce(text, ''),
    chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '')"""


def query(name: str, sql: str | None = None):
    def register(plan):
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return register


@query("op1_token_counts")
def op1(spark, sf):
    counted = token_counts.count_tokens(table(spark, sf, "documents"))
    return counted.select(
        "doc_id", "n_tokens", "outside_tokens", "crossing_tokens",
        F.size("section_tokens").cast("long").alias("n_sections"), "section_tokens")


LIMITS = quality_cascade.Limits()
STOPS = ", ".join(f"'{w}'" for w in quality_cascade.STOP_WORDS)

QUALITY_SQL = f"""
WITH w AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS words,
         string_split(coalesce(text, ''), chr(10)) AS all_lines
  FROM documents),
d AS (
  SELECT *, len(words)::BIGINT AS n_words,
         list_filter(all_lines, lambda x: trim(translate(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13),
                     '     ')) <> '') AS lines,
         length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols
  FROM w),
win AS (
  SELECT row_no, i, words[i:i+4] AS g
  FROM (SELECT row_no, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
again AS (
  SELECT row_no, i FROM win
  QUALIFY count(*) OVER (PARTITION BY row_no, g) > 1),
covered AS (
  SELECT row_no, sum(least(5, coalesce(next_i - i, 5)))::BIGINT AS n_repeat_words
  FROM (SELECT row_no, i, lead(i) OVER (PARTITION BY row_no ORDER BY i) AS next_i FROM again)
  GROUP BY row_no),
m AS (
  SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, words, all_lines, len(lines) AS n_lines,
         n_words < {LIMITS.min_words}
           OR 100 * coalesce(n_repeat_words, 0) > {LIMITS.max_repeat_percent} * n_words AS base_failed
  FROM d LEFT JOIN covered USING (row_no))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR n_symbols * 100 > n_words * {LIMITS.max_symbol_percent}
            OR word_chars < n_words * {LIMITS.min_mean_word} OR word_chars > n_words * {LIMITS.max_mean_word}
            OR n_dup_lines * 100 > n_lines * {LIMITS.max_dup_line_percent}
            OR len(list_filter(words, lambda x: NOT regexp_matches(x, '\\p{{L}}'))) * 100
               > n_words * {LIMITS.max_bare_word_percent}
            OR len(list_filter(words, lambda x: lower(x) IN ({STOPS}))) < {LIMITS.min_stop_words}
            OR len(list_filter(words, lambda x, i: i > 1 AND x = words[i - 1])) * 100
               > n_words * {LIMITS.max_stutter_percent}
            OR len(list_filter(all_lines, lambda x: regexp_matches(rtrim(x), '(\\.\\.\\.|…)$'))) * 100
               > n_lines * {LIMITS.max_ellipsis_percent}
            OR len(list_filter(all_lines, lambda x: regexp_matches(ltrim(x), '^[-*•]'))) * 100
               > n_lines * {LIMITS.max_bullet_percent}) AS kept
FROM m"""


@query("op3_quality_rules", QUALITY_SQL)
def op3(spark, sf):
    judged = quality_cascade.quality_cascade(table(spark, sf, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


LINES_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT row_no, doc_id, text, unnest(range(len(parts))) AS n, unnest(parts) AS raw FROM docs WHERE text IS NOT NULL),
full_lines AS (
  SELECT row_no, doc_id, n, trim(raw, ' ' || chr(9) || chr(13)) AS line,
         len(regexp_extract_all(raw, '{NO_SPACE}+')) AS words,
         row_number() OVER (PARTITION BY row_no ORDER BY n) AS k
  FROM lines WHERE trim(raw, ' ' || chr(9) || chr(13)) <> ''),
runs AS ({" UNION ALL ".join(f"""
  SELECT row_no, doc_id, k, {size} AS size, list(line) OVER w AS g, list(n) OVER w AS ns, sum(words) OVER w AS words
  FROM full_lines
  WINDOW w AS (PARTITION BY row_no ORDER BY k ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)"""
  for size in range(1, line_winnow.RUN + 1))}),
later AS (
  SELECT row_no, ns FROM runs WHERE len(g) = size AND (size = {line_winnow.RUN} OR words >= {line_winnow.WORDS})
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, k) > 1),
gone AS (SELECT DISTINCT row_no, unnest(ns) AS n FROM later),
per_doc AS (
  SELECT row_no, count(*) AS n_removed FROM gone GROUP BY row_no),
kept AS (
  SELECT row_no, string_agg(raw, chr(10) ORDER BY n) AS kept_text
  FROM lines ANTI JOIN gone USING (row_no, n) GROUP BY row_no)
SELECT doc_id, len(parts)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN text IS NOT NULL THEN md5(coalesce(kept_text, '')) END AS text_md5
FROM docs LEFT JOIN per_doc USING (row_no) LEFT JOIN kept USING (row_no)"""


@query("op4_line_dedup", LINES_SQL)
def op4(spark, sf):
    docs = table(spark, sf, "documents").withColumn(
        "n_lines", F.size(F.split("text", "\n", -1)).cast("long"))
    out = line_winnow.dedup_lines(docs.select("doc_id", "text", "n_lines"), removed="gone")
    return out.select(
        "doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), F.md5("text").alias("text_md5"))


def held_out(id_col):
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def fold(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % 3


def language_model(docs: DataFrame) -> language_id.Model:
    """Learned from the documents of two folds out of three."""
    return language_id.fit(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))


@query("op5_language_id")
def op5(spark, sf):
    docs = table(spark, sf, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_model(docs))
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


URL_RULES = [
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
]
LISTED_HOST = "(^|[.-])(casino|poker|pills|loans)"   # hosts whose pages make up the list

URL_SQL = f"""
WITH u AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                  '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         coalesce(regexp_extract(url, '^.*?://[^?#]*\\?([^#]*)', 1, 's'), '') AS query
  FROM pages),
c AS (
  SELECT *, CASE WHEN regexp_replace(regexp_replace(host, '^(www|m)\\.', ''), ':[0-9]*$', '') <> '' THEN
         regexp_replace(regexp_replace(host, '^(www|m)\\.', ''), ':[0-9]*$', '')
         || regexp_replace(path, '/+$', '')
         || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical
  FROM (SELECT *, list_sort(list_filter(string_split(query, '&'),
               lambda p: p <> '' AND NOT regexp_matches(p, '^({"|".join(url_filter.TRACKING)})='))) AS kept FROM u)),
listed AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '{LISTED_HOST}') AND canonical IS NOT NULL),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM c)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM r"""


@query("op7_url_filter", URL_SQL)
def op7(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    listed = pages.where(url_filter.host_of(F.col("url")).rlike(LISTED_HOST)).select("url")
    return url_filter.filter_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


WARC_SQL = f"""
WITH p AS (
  SELECT row_number() OVER () AS row_no, page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (
  SELECT *, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest,
         min(page_id) OVER (PARTITION BY payload) AS first_id
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {warc.MIN_REVISIT} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {warc.MIN_REVISIT} AND page_id <> first_id THEN first_id END AS refers_to
FROM d"""


@query("op8_warc", WARC_SQL)
def op8(spark, sf):
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.page_records(table(spark, sf, "pages")), path)
    read = warc.read_warc(spark, path, ["record_id", "record_type", "refers_to", "payload_digest", "full_length", "payload"])
    whole = F.col("record_type") == "response"
    return read.select(
        warc.page_of(F.col("record_id")).cast("long").alias("page_id"),
        F.when(whole, F.octet_length("payload")).otherwise(F.col("full_length")).cast("long").alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type",
        warc.page_of(F.col("refers_to")).cast("long").alias("refers_to"))


@query("op9_substring_dedup")
def op9(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.char_length("text").alias("chars"))
    out = substring_dedup.dedup_passages(docs)
    return out.select(
        "doc_id", F.size("removed").cast("long").alias("n_removed"),
        (F.col("chars") - F.char_length("text")).cast("long").alias("removed_chars"),
        F.transform("removed", lambda s: s["start"]).alias("starts"),
        F.transform("removed", lambda s: s["end"]).alias("ends"), F.md5("text").alias("text_md5"))


@query("op10_best_fit_packing")
def op10(spark, sf):
    return packing.pack(table(spark, sf, "documents"))


@query("op2_ngram_jaccard_join")
def op2(spark, sf):
    found = ngram_join.near_duplicates(table(spark, sf, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("group_id").alias("class_id"), "n_links", "n_copies")


@query("op6_decontamination")
def op6(spark, sf):
    found = decontaminate.find_matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "distance", "first_word", "end_word")


@query("op12_conversation_repair")
def op12(spark, sf):
    spoilt = conversation_repair.damage(table(spark, sf, "conversations"))
    report, prepared = conversation_repair.repair(spoilt, copies="copies")
    return conversation_repair.repaired_digests(prepared, report)


@query("op13_topk_search", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(c::DOUBLE * 256) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x::DOUBLE[], c.x::DOUBLE[]) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 5""")
def op13(spark, sf):
    return metric_search.top_k(table(spark, sf, "embeddings"))


@query("op11_embedding_whitening")
def op11(spark, sf):
    out = whitening.whiten(table(spark, sf, "embeddings"))
    parts = F.posexplode(F.arrays_zip("whitened", "explained"))
    return out.select("id", "n", "deviation", "identity_error", parts.alias("at", "c")).select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), "n",
        F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"), "identity_error")
