"""The queries of this package over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.llm.decontaminate import flagged
from pagegraph.llm.exact_dedup import exact_dedup
from pagegraph.llm.language_id import language_id
from pagegraph.llm.line_dedup import LINES, LONG, line_dedup
from pagegraph.llm.mixing import DRAWS, SEED, SPACE, STEP, mixing_plan
from pagegraph.llm.repeats import repeat_dedup
from pagegraph.llm.simhash import simhash_components
from pagegraph.llm.token_planes import token_planes
from pagegraph.llm.url_filter import url_filter
from pagegraph.llm.warc import archive

#: What op6 puts after each document.
END_ID = 2
#: The rule list of op10: host, path, verdict.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op5_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes(_read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flagged(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "item_ids")


def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeat_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"), with_bytes=True)
    # A cut may leave a part of a character, which is U+FFFD in kept_text; the hash is that of the bytes.
    kept_text = F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeated", kept_text)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_source_mixing": op2_source_mixing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language_id": op4_language_id,
    "op5_line_winnowing": op5_line_winnowing,
    "op6_token_planes": op6_token_planes,
    "op7_simhash": op7_simhash,
    "op8_decontaminate": op8_decontaminate,
    "op9_repeated_bytes": op9_repeated_bytes,
    "op10_url_filter": op10_url_filter,
}

_SOLID = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
g AS (SELECT *, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest,
             max(page_id) OVER (PARTITION BY payload) AS last, count(*) OVER (PARTITION BY payload) AS n FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> last AND payload_bytes >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> last AND payload_bytes >= 1000 THEN last END AS refers_to FROM g""",
    "op2_source_mixing": rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS i, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS draw
  FROM documents),
sources AS (
  SELECT source, source_size, source_size * 3 AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source)),
ordered AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM sources),
levelled AS (
  SELECT *, CAST(total - held AS DOUBLE) / CAST(rest AS DOUBLE) AS level FROM ordered),
stopped AS (
  SELECT *, cap <= level * weight AS capped FROM levelled),
goal AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE)
           ELSE coalesce(CAST(total - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0) AS DOUBLE) / CAST(sum(weight) FILTER (WHERE NOT capped) OVER () AS DOUBLE) * weight, 0) END AS target
  FROM stopped),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM goal),
below AS (
  SELECT *, CAST(floor(rate) AS BIGINT) AS whole, CAST(floor((rate - floor(rate)) * {SPACE}) AS BIGINT) AS below FROM rates),
tried AS (
  SELECT b.source, k, abs(CAST(sum((whole + CASE WHEN (draw + k * {STEP}) % {SPACE} < below THEN 1 ELSE 0 END) * size) AS DOUBLE) - any_value(target)) AS off
  FROM docs d JOIN below b ON d.source IS NOT DISTINCT FROM b.source, range({DRAWS}) r(k) GROUP BY b.source, k),
best AS (SELECT source, arg_min(k, (off, k)) AS k FROM tried GROUP BY source)
SELECT doc_id, size, source_size, target,
       CAST(least(whole + CASE WHEN (draw + k * {STEP}) % {SPACE} < below THEN 1 ELSE 0 END, 3) * size AS BIGINT) AS taken
FROM docs d JOIN below b ON d.source IS NOT DISTINCT FROM b.source JOIN best c ON d.source IS NOT DISTINCT FROM c.source""",
    "op3_exact_dedup": rf"""
WITH docs AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, sha256({_SOLID}) AS text_sha256 FROM documents)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM docs)""",
    "op5_line_winnowing": rf"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT k, doc_id, l, p, l[p : p + {LINES - 1}] AS part FROM docs, unnest(range(1, len(l) - {LINES - 2})) u(p)),
f AS (SELECT *, first_value(k || ':' || p) OVER (PARTITION BY part ORDER BY doc_id NULLS LAST, p) AS first FROM w),
parts AS (SELECT k, doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM docs),
long AS (SELECT k, i, first_value(k || ':' || i) OVER (PARTITION BY x ORDER BY doc_id NULLS LAST, i) AS first FROM parts WHERE length(x) >= {LONG}),
gone AS (SELECT DISTINCT k, unnest(range(p, p + {LINES})) AS i FROM f WHERE first <> k || ':' || p
         UNION SELECT k, i FROM long WHERE first <> k || ':' || i),
kept AS (SELECT q.k, q.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(q.x, chr(10) ORDER BY q.i) FILTER (WHERE g.i IS NULL) AS text
         FROM parts q LEFT JOIN gone g ON q.k = g.k AND q.i = g.i GROUP BY q.k, q.doc_id)
SELECT doc_id, CAST(n_lines AS INTEGER) AS n_lines, CAST(n_removed AS INTEGER) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM kept""",
    "op10_url_filter": r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, host, path, max_by(h || p, length(h) * 1000 + length(p)) AS rule, max_by(v, length(h) * 1000 + length(p)) AS v
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT q.page_id, q.host, q.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM parts q LEFT JOIN fits f ON q.page_id IS NOT DISTINCT FROM f.page_id AND q.host = f.host AND q.path = f.path""",
}
