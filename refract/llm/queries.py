"""The opN queries: thin bindings of the operators to the test tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, conversation_trie, decontaminate, spelling, tensored_banding
from .chat_format import rotate_perspectives
from .conversation_trie import prefix_trie
from .decontaminate import contaminated
from .fingerprint import fingerprint_edits
from .html_wrapper import extract_main_text
from .jaccard_join import near_duplicates
from .language_id import identify
from .lm_score import score_documents
from .mixing import mix_sources
from .spelling import spelling_variants
from .substring_dedup import dedup_substrings
from .suffix_dedup import dedup_bytes
from .tensored_banding import near_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), with_text=False).drop("cls", "kept_text")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what the labels call good and not toxic."""
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return score_documents(table(spark, sf_dir, "documents"), good)


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key", "first")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), graft=True)


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).drop("text_key")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_mixing": op3_mixing,
    "op4_lm_score": op4_lm_score,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_fingerprint": op6_fingerprint,
    "op7_language_id": op7_language_id,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_html_text": op9_html_text,
    "op10_chat_format": op10_chat_format,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_minhash_dedup": op12_minhash_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}
#: DuckDB forms.  A window is a list of words or a run of hex digits that starts at i; a unit is removed if one of
#: the windows that end with it or later, and start at most 49 before, starts in a smaller document as well.
OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL) x),
f AS (SELECT k, min(doc_id) AS least FROM s GROUP BY k HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT r, i FROM s JOIN f USING (k) WHERE least < doc_id),
u AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
m AS (SELECT u.r, u.i, u.word, coalesce(max(CASE WHEN g.i IS NOT NULL THEN u.i END) OVER (PARTITION BY u.r ORDER BY u.i), -99) > u.i - 50 AS gone FROM u LEFT JOIN g ON g.r = u.r AND g.i = u.i),
t AS (SELECT r, count(*) AS n, count(*) FILTER (gone) AS k, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(k, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""
OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, doc_id, i, md5(substr(h, 2 * i - 1, 100)) AS k FROM (SELECT r, doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS i FROM d WHERE length(h) >= 100 AND doc_id IS NOT NULL) x),
f AS (SELECT k, min(doc_id) AS least FROM s GROUP BY k HAVING min(doc_id) < max(doc_id)),
g AS (SELECT r, i FROM s JOIN f USING (k) WHERE least < doc_id),
e AS (SELECT r, i, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -99) + 50 THEN 1 ELSE 0 END AS new FROM g),
c AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS span FROM e),
p AS (SELECT r, span, min(i) AS a, max(i) + 49 AS b FROM c GROUP BY r, span),
q AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM p),
t AS (SELECT q.r, sum(b - a + 1) AS k, count(*) AS n, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY a) AS kept FROM q JOIN d USING (r) GROUP BY q.r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""
OP8 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, k FROM (SELECT r, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5) x UNION ALL SELECT r, array_to_string(w, ' ') || ' .' || len(w) FROM d WHERE len(w) BETWEEN 1 AND 4) y),
z AS (SELECT r, count(*) AS n, md5(string_agg(k, chr(10) ORDER BY k)) AS cls FROM s GROUP BY r),
o AS (SELECT cls, min(doc_id) AS owner, count(*) AS docs, min(r) AS rep, min(n) AS n FROM z JOIN d USING (r) WHERE doc_id IS NOT NULL GROUP BY cls),
l AS (SELECT a.cls AS x, b.cls AS y FROM s sa JOIN s sb ON sa.k = sb.k JOIN o a ON a.rep = sa.r JOIN o b ON b.rep = sb.r WHERE a.cls <> b.cls GROUP BY a.cls, b.cls, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
reach AS (SELECT cls AS x, cls AS y FROM o UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
c AS (SELECT x AS cls, min(owner) AS class_id FROM reach JOIN o ON o.cls = reach.y GROUP BY x),
k AS (SELECT x AS cls, count(*) AS texts, sum(docs) AS docs FROM l JOIN o ON o.cls = l.y GROUP BY x)
SELECT doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, CASE WHEN doc_id IS NOT NULL THEN coalesce(owner, doc_id) END AS copy_of, CASE WHEN doc_id IS NOT NULL THEN coalesce(class_id, doc_id) END AS class_id,
  CAST(CASE WHEN doc_id IS NULL THEN 0 ELSE coalesce(k.docs, 0) + coalesce(o.docs - 1, 0) END AS BIGINT) AS n_links, CAST(CASE WHEN doc_id IS NULL THEN 0 ELSE coalesce(k.texts, 0) END AS BIGINT) AS n_text_links
FROM d LEFT JOIN z USING (r) LEFT JOIN o USING (cls) LEFT JOIN c USING (cls) LEFT JOIN k USING (cls)
"""

ORACLES: dict[str, str] = {
    "op1_substring_dedup": OP1,
    "op5_suffix_dedup": OP5,
    "op8_jaccard_join": OP8,
    "op2_decontamination": decontaminate.ORACLE,
    "op10_chat_format": chat_format.ORACLE,
    "op11_conversation_trie": conversation_trie.ORACLE,
    "op12_minhash_dedup": tensored_banding.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
