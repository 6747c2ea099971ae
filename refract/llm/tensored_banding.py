"""MinHash near-duplicate detection by tensored banding, verified exactly.

A table of an LSH index is keyed by WIDTH minima that must all agree.  Instead of drawing the minima of every
table anew, two collections of COLLECTION half keys (HALF minima each) are drawn, and each pair of a half key of
the first and one of the second is the key of a table: COLLECTION ** 2 tables of 2 * HALF minima for
2 * COLLECTION * HALF minima in all.  At 13 and 3 that is 169 tables of 6 minima from 78 instead of 1014.

Two sets of similarity s meet in some table exactly if they share a half key of either collection, so the tables
find them with the chance (1 - (1 - s ** HALF) ** COLLECTION) ** 2 (``recall``), 0.99999 at 0.85.  A table can thus
be skipped for a class whose half key nobody shares: pairs are combined among shared halves only.

Each table tells a class one other, the smallest of those that share its key; what is close to it joins its cell
and the others are led as in the forest join, so no group is written as its pairs.  Cells are verified on whole
shingle sets (jaccard_join), and only verified links make components.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard_join as J
from .common import materialise, unsent

SHINGLE, THRESHOLD = 3, (17, 20)
COLLECTION, HALF = 13, 3


def recall(similarity: float, collection: int = COLLECTION, half: int = HALF) -> float:
    """The chance that two sets of the given similarity meet in a table."""
    return (1 - (1 - similarity**half) ** collection) ** 2


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Documents x half keys (first collection, then second) x minima."""
    return J.signatures(h, first, 2 * COLLECTION, HALF)


def _halves(classes: DataFrame, start: int) -> DataFrame:
    """class, parts: hashes of the half keys of a collection that other classes have too, class by class."""
    at = F.explode(F.sequence(F.lit(start), F.lit(start + COLLECTION - 1))).alias("at")
    part = F.xxhash64("at", F.expr(f"substring(sig, at * {2 * HALF} + 1, {2 * HALF})"))
    rows = classes.select("class", "sig", at).select("class", part.alias("part"))
    shared = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("part")
    return rows.join(unsent(shared), "part").groupBy("class").agg(F.collect_list("part").alias("parts"))


def _cells(classes: DataFrame) -> DataFrame:
    """node, root: cells of the classes (class, sig) that meet in the tables."""
    left, right = _halves(classes, 0), _halves(classes, COLLECTION)
    both = left.join(unsent(right.withColumnRenamed("parts", "others")), "class")
    rows = both.select("class", F.explode("parts").alias("one"), "others").select("class", "one", F.explode("others").alias("two"))
    rows = materialise(rows.select("class", F.xxhash64("one", "two").alias("node")), "tables")
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("hub")).where("n > 1").select("node", "hub")
    return J.joined(rows.join(unsent(nodes), "node").where("class <> hub").select("node", F.lit(0).alias("key"), "class", "hub"), classes)


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of 17/20 at least of their sets of three-word shingles.

    Words are ``[^\\x20\\x09-\\x0D]+`` of whole texts in which A-Z are lower-cased.  Rows: doc_id, n_shingles (set
    size), component_id (smallest doc_id reachable, itself included), kept (doc_id = component_id), text_key.

    * a text of one or two words has one shingle, all its words; null text and text without words have none, are
      linked with nothing and kept;
    * rows with a null doc_id are linked with nothing: component_id is null, they are kept;
    * repeated rows are documents each, linked as copies; rows that repeat a doc_id are judged by their own text;
    * other columns are not read; an empty table gives an empty result.
    """
    text = F.translate(F.col("text").cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    found = J.near_duplicates(docs.select("doc_id", text.alias("text")), shingle, threshold, signatures, _cells)
    kept = F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True))
    return found.select("doc_id", "n_shingles", F.col("class_id").alias("component_id"), kept.alias("kept"), "text_key")


ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT r, k FROM (
    SELECT r, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3) x
    UNION ALL SELECT r, array_to_string(w, ' ') || ' .' || len(w) FROM d WHERE len(w) BETWEEN 1 AND 2) y),
z AS (SELECT r, count(*) AS n, md5(string_agg(k, chr(10) ORDER BY k)) AS cls FROM s GROUP BY r),
o AS (SELECT cls, min(doc_id) AS owner, min(r) AS rep, min(n) AS n FROM z JOIN d USING (r) WHERE doc_id IS NOT NULL GROUP BY cls),
l AS (
  SELECT a.cls AS x, b.cls AS y FROM s sa JOIN s sb ON sa.k = sb.k JOIN o a ON a.rep = sa.r JOIN o b ON b.rep = sb.r
  WHERE a.cls <> b.cls GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT cls AS x, cls AS y FROM o UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
c AS (SELECT x AS cls, min(owner) AS least FROM reach JOIN o ON o.cls = reach.y GROUP BY x)
SELECT doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, CASE WHEN doc_id IS NOT NULL THEN coalesce(least, doc_id) END AS component_id,
  coalesce(doc_id = coalesce(least, doc_id), true) AS kept
FROM d LEFT JOIN z USING (r) LEFT JOIN c USING (cls)
"""
