"""Registered queries of the rule and format operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from judgealign.llm import chat_format, host_rules, line_dedup, url_filter

#: The rules that the query applies: fixed values.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op2_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT DISTINCT host, path, rhost || rpath AS rule, rverdict
  FROM (SELECT DISTINCT host, path FROM p) u JOIN r
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) = 1)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.rverdict, 'allow') AS verdict
FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path
"""


def op5_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string"
    )
    return chat_format.digests(chat_format.format_conversations(turns.unionByName(own)))


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) AS size,
         length(role) + length(regexp_replace(role, '[^\\<\[]', '', 'g')) AS role_size,
         row_number() OVER w AS k,
         CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS opens
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       cast(sum(size + CASE WHEN opens = 1 THEN 9 + role_size + 6 + 4 ELSE 6 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""


def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return line_dedup.kept_digests(docs, line_dedup.line_bitmaps(docs, min_docs=10, keep="none"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(k.doc_id) AS doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY r
"""


def op10_host_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    judged = host_rules.judge_documents(docs)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM s),
m AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, t) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM m) GROUP BY r),
b AS (
  SELECT d.r, doc_id, source, cast(len(w) AS BIGINT) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep ON d.r = rep.r),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS failed FROM f GROUP BY source),
q AS (SELECT avg(failed / n) AS m, var_pop(failed / n) AS v FROM h),
z AS (SELECT m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 1e-6) ELSE 1e6 END AS s FROM q),
j AS (SELECT source, (failed + m * s) / (n + s) <= 0.5 AS ok FROM h, z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM f JOIN j ON f.source IS NOT DISTINCT FROM j.source
"""

QUERIES = {"op2_url_filter": op2_url_filter, "op5_chat_format": op5_chat_format, "op8_line_dedup": op8_line_dedup, "op10_host_rules": op10_host_rules}
ORACLES = {"op2_url_filter": OP2_SQL, "op5_chat_format": OP5_SQL, "op8_line_dedup": OP8_SQL, "op10_host_rules": OP10_SQL}
