"""Queries over documents, pages and events as if they were files with contents and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import xml_text
from ..operators import forensics, relational
from ..registry import query, table

def content():
    return F.col("text").cast("binary")


@query("""SELECT doc_id, sha256(text) AS sha256, sha256(text) AS sha256_head10m, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents""")
def file_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", *forensics.fingerprint(content()))


@query("""WITH h AS (SELECT doc_id, substr(hex(encode(text)), 1, 131072) AS h FROM documents),
b AS (SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS byte FROM h),
c AS (SELECT doc_id, byte, count(*) AS n FROM b GROUP BY doc_id, byte),
p AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM c)
SELECT doc_id, round(sum(-p * log2(p)), 6) AS entropy, CASE WHEN sum(-p * log2(p)) > 7.5 THEN 'high' ELSE 'low' END AS level FROM p GROUP BY doc_id""")
def byte_entropy(spark, d):
    e = table(spark, d, "documents").select("doc_id", forensics.byte_entropy(content()).alias("e"))
    return e.select("doc_id", F.round("e", 6).alias("entropy"), F.when(F.col("e") > 7.5, "high").otherwise("low").alias("level"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(substr(hex(encode(text)), 1, 64), '(..)', '\\1 ', 'g'), '((?:.. ){8})', '\\1 ', 'g')) AS magic_hex FROM documents""")
def head_hex(spark, d):
    return table(spark, d, "documents").select("doc_id", forensics.head_hex(content()).alias("magic_hex"))


@query("""WITH b AS (SELECT doc_id, unnest(regexp_extract_all(substr(hex(encode(text)), 1, 131072), '..')) AS byte FROM documents)
SELECT byte, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs FROM b GROUP BY byte""")
def byte_histogram(spark, d):
    h = forensics.byte_histogram(table(spark, d, "documents"), "doc_id", content())
    return h.groupBy("byte").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query("""SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>') THEN trim(replace(replace(replace(replace(replace(regexp_replace(
  regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1), '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', '''')) END AS title,
  regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages""")
def xml_title(spark, d):
    return table(spark, d, "pages").select("page_id", xml_text(F.col("html"), "title").alias("title"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<p[ >]')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(html, '(?i)<a[ >]')) AS BIGINT) AS links FROM pages""")
def markup_counts(spark, d):
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("bigint")
    return table(spark, d, "pages").select("page_id", n("(?i)<p[ >]").alias("paragraphs"), n("(?i)<a[ >]").alias("links"))


@query("""SELECT event_id, 'k' AS tag, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def tag_flatten(spark, d):
    return relational.flatten(table(spark, d, "events"), "event_id", "props")


@query("""SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license') OR contains(lower(lang), 'license')""")
def metadata_search(spark, d):
    return relational.search(table(spark, d, "documents"), ["text", "source", "lang"], "LICENSE").select("doc_id", "source")


@query("""SELECT CAST(c_custkey AS BIGINT) AS c_custkey, 'format' AS category, u.property, u.value FROM (
  SELECT c_custkey, 'c_name' AS property, c_name AS value FROM customer UNION ALL
  SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer UNION ALL
  SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer) u""")
def metadata_csv_unpivot(spark, d):
    u = relational.unpivot(table(spark, d, "customer"), "c_custkey", "format", ["c_name", "c_mktsegment", "c_nationkey"])
    return u.select("c_custkey", "category", "property", "value")
