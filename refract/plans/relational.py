"""Links, intervals, windows and unions over the relational test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..registry import dealt, dealt_sql, inline_sql, literal, query, table


@query("""SELECT b.item_id FROM (SELECT item_id, sha256(text) AS h FROM benchmark) b WHERE h NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL)""")
def assertion_missing(spark, d):
    refs = table(spark, d, "benchmark").select("item_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    boxes = table(spark, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("hash")).distinct()
    return R.missing(refs, boxes, "hash").select("item_id")


@query("""WITH h AS (SELECT doc_id, source, sha256(text) AS h FROM documents) SELECT a.source, CAST(count(*) AS BIGINT) AS links, CAST(count(DISTINCT a.h) AS BIGINT) AS texts FROM h a
JOIN (SELECT h, min(doc_id) AS first FROM h GROUP BY h) f ON a.h = f.h AND a.doc_id > f.first GROUP BY a.source""")
def hash_link_check(spark, d):
    h = table(spark, d, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    first = h.groupBy("hash").agg(F.min("doc_id").alias("first"))
    return h.join(first, "hash").where("doc_id > first").groupBy("source").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("hash").alias("texts"))


@query("""SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, n_name, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS issuer FROM nation""")
def chain_next(spark, d):
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    return table(spark, d, "nation").select(F.col("n_regionkey").cast("bigint").alias("n_regionkey"), "n_name", F.lead("n_name").over(w).alias("issuer"))


@query("""WITH s AS (SELECT o_custkey, CAST(epoch(o_orderdate) / 86400 AS BIGINT) AS lo, CAST(epoch(o_orderdate) / 86400 AS BIGINT) + 30 AS hi FROM orders),
g AS (SELECT o_custkey, lo, max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_from FROM s)
SELECT CAST(o_custkey AS BIGINT) AS o_custkey, gap_from, lo AS gap_to FROM g WHERE gap_from < lo""")
def interval_gaps(spark, d):
    day = F.floor(F.unix_timestamp("o_orderdate") / 86400).cast("bigint")
    s = table(spark, d, "orders").select("o_custkey", day.alias("lo"), (day + 30).alias("hi"))
    return R.gaps(s, "o_custkey", "lo", "hi")


@query("""WITH p AS (SELECT event_id, CAST(floor(epoch(ts) - (SELECT min(epoch(ts)) FROM events)) AS BIGINT) AS spot FROM events),
s AS (SELECT o_orderkey, (o_orderkey * 7919) % 600000 AS lo, (o_orderkey * 7919) % 600000 + 100 AS hi FROM orders)
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(count(*) AS BIGINT) AS n FROM p JOIN s ON spot BETWEEN lo AND hi GROUP BY o_orderkey""")
def range_cover(spark, d):
    e = table(spark, d, "events")
    start = e.agg(F.min(F.col("ts").cast("timestamp").cast("double")).alias("t0"))  # one row
    p = e.crossJoin(F.broadcast(start)).select("event_id", F.floor(F.col("ts").cast("timestamp").cast("double") - F.col("t0")).cast("bigint").alias("at"))
    lo = (F.col("o_orderkey") * 7919) % 600000
    s = table(spark, d, "orders").select("o_orderkey", lo.alias("lo"), (lo + 100).alias("hi"))
    return R.cover_counts(p, "at", s, "o_orderkey", "lo", "hi", 1000)


_ANCHORS = ["(1, 'root a', 'a')", "(2, 'root b', 'b')", "(3, 'root a again', 'a')"]
_CERTS = ["('leaf', 'b')", "('other', 'a')", "('alone', 'c')"]


@query(f"""SELECT cert, arg_min(anchor, ordinal) AS anchor FROM (SELECT * FROM {dealt_sql("cert, issuer", _CERTS)}) c LEFT JOIN (SELECT * FROM {inline_sql("ordinal, anchor, subject", _ANCHORS)}) a ON issuer = subject GROUP BY cert""")
def first_match_anchor(spark, d):
    c, a = dealt(spark, d, "cert, issuer", _CERTS), literal(spark, "ordinal, anchor, subject", _ANCHORS)
    return c.join(F.broadcast(a), F.col("issuer") == F.col("subject"), "left").groupBy("cert").agg(F.min_by("anchor", "ordinal").alias("anchor"))


_MAPS = ["('f', 'Make', 'Canon', 0)", "('f', 'Model', 'R5', 0)", "('f', 'Make', 'Canon Inc.', 1)", "('g', 'Make', 'Sony', 0)", "('g', 'Software', 'x', 1)"]


@query(f"""SELECT path, key, arg_max(value, side) AS value FROM {dealt_sql("path, key, value, side", _MAPS)} GROUP BY path, key""")
def map_union_last_wins(spark, d):
    return R.last_wins(dealt(spark, d, "path, key, value, side", _MAPS), ["path", "key"], "side").select("path", "key", "value")


@query("""SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(greatest(0, least(n - 3, (turn // 3) * 3)) AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS turns FROM (
SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) c GROUP BY conv_id, greatest(0, least(n - 3, (turn // 3) * 3))""")
def preview_windows(spark, d):
    c = table(spark, d, "conversations")
    n = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    start = F.greatest(F.lit(0), F.least(F.col("n") - 3, F.floor(F.col("turn") / 3) * 3)).cast("bigint")
    return c.join(n, "conv_id").groupBy("conv_id", start.alias("start")).agg(F.count(F.lit(1)).alias("turns"))


@query("""SELECT event_type, round(sum(value) / sum(sum(value)) OVER () * 100, 6) AS share FROM events GROUP BY event_type""")
def energy_share(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("v"))
    return e.select("event_type", F.round(F.col("v") / F.sum("v").over(Window.partitionBy()) * 100, 6).alias("share"))


_PRIORITY = ["Make", "Model", "Software", "CreateDate"]
_TAG_ROWS = ["('f', 'Zoom', '1')", "('f', 'Model', 'R5')", "('f', 'Artist', 'x')", "('f', 'Make', 'Canon')", "('f', 'xmp_history', '[]')", "('g', 'Software', '')", "('g', 'Software', 'x')", "('g', 'CreateDate', '2024')"]


@query(f"""SELECT path, key, value, CAST(row_number() OVER (PARTITION BY path ORDER BY CASE key WHEN 'Make' THEN 1 WHEN 'Model' THEN 2 WHEN 'Software' THEN 3 WHEN 'CreateDate' THEN 4 ELSE 999 END, key) AS INTEGER) AS place
FROM {dealt_sql("path, key, value", _TAG_ROWS)} WHERE key NOT IN ('xmp_history') AND value <> ''""")
def tag_priority_sort(spark, d):
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, _PRIORITY)), F.col("key")), F.lit(0)), F.lit(999))
    t = dealt(spark, d, "path, key, value", _TAG_ROWS).where("key <> 'xmp_history' AND value <> ''")
    return t.select("path", "key", "value", F.row_number().over(Window.partitionBy("path").orderBy(rank, "key")).alias("place"))
