"""Report choices over tags that are dealt to documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog
from ..operators import origin
from ..registry import dealt, dealt_sql, query, table

_ROWS = [
    "('a', 1, 'CreateDate', '2024-01-02')", "('a', 2, 'Software', 'Stable Diffusion XL, skia/pdf')", "('a', 3, 'ai_prompt', 'a cat')", "('b', 1, 'year', '1999')", "('b', 2, 'ModifyDate', '2000-01-01')", "('b', 3, 'encoder', 'Suno v3.5 python-docx')",
    "('c', 1, 'title', '')", "('c', 2, 'Software', 'FLUX.1 dev via pandoc')", "('d', 1, 'comment', 'Veo 3 clip made by DALL-E 3')", "('d', 2, 'comment', 'second')", "('d', 3, 'imageWidth_px', '1024')",
]
_COLS = "path, ordinal, key, value"
_T = f"(SELECT path, key, arg_min(value, ordinal) AS value FROM {dealt_sql(_COLS, _ROWS)} GROUP BY path, key)"


def _maps(spark, d):
    return origin.tag_maps(dealt(spark, d, _COLS, _ROWS))


_PLACE = " ".join(f"WHEN '{k}' THEN {i}" for i, (k, _) in enumerate(origin.CREATED))
_SOURCE = " ".join(f"WHEN '{k}' THEN '{s}'" for k, s in origin.CREATED)


@query(f"""SELECT path, arg_min(value, CASE key {_PLACE} END) AS value, arg_min(CASE key {_SOURCE} END, CASE key {_PLACE} END) AS source FROM {_T} x WHERE value <> '' AND key IN ({", ".join(f"'{k}'" for k, _ in origin.CREATED)}) GROUP BY path""")
def creation_choice(spark, d):
    return _maps(spark, d).withColumn("c", origin.created(F.col("tags"))).where("c IS NOT NULL").select("path", "c.value", "c.source")


_Q = lambda s: s.replace("'", "''")
_MODEL = ", ".join(f"nullif(trim(regexp_extract(value, '(?i){_Q(p)}', 0)), '')" for p in catalog.MODEL_PATTERNS)


@query(f"SELECT path, key, coalesce({_MODEL}) AS model FROM {_T} x WHERE coalesce({_MODEL}) IS NOT NULL")
def model_names(spark, d):
    t = _maps(spark, d).select("path", F.explode("tags").alias("key", "value")).withColumn("model", origin.model_name(F.col("value")))
    return t.where("model IS NOT NULL").select("path", "key", "model")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT path, '{_Q(n)}' AS hint FROM {_T} x WHERE regexp_matches(value, '(?i){_Q(p)}')" for p, n in catalog.SCRIPT_GENERATORS) + ") h")
def script_hints(spark, d):
    t = _maps(spark, d).select("path", F.explode("tags").alias("key", "value"))
    return t.select("path", F.explode(origin.script_hints(F.col("value"))).alias("hint"))


@query(f"""SELECT path, key, value FROM {_T} x WHERE value <> '' AND key NOT IN ({", ".join(f"'{k}'" for k in origin.HIDDEN)})""")
def tag_visible(spark, d):
    return _maps(spark, d).select("path", F.explode(origin.visible(F.col("tags"))).alias("key", "value"))


_SIZES = "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 64 * (doc_id % 20) + CASE WHEN doc_id % 4 = 0 THEN 10 ELSE 0 END END AS w, 64 * (doc_id % 7) AS h, doc_id % 5 = 0 AS camera"


@query(f"SELECT doc_id, coalesce(w >= 512 AND w % 64 = 0 AND h % 64 = 0 AND NOT camera, false) AS hint FROM (SELECT doc_id, {_SIZES} FROM documents) x")
def size_hints(spark, d):
    sizes = table(spark, d, "documents").selectExpr("doc_id", *_SIZES.replace("AS w, ", "AS w;").replace("AS h, ", "AS h;").split(";"))
    return sizes.select("doc_id", origin.size_hint(F.col("w"), F.col("h"), F.col("camera")).alias("hint"))


@query(f"""SELECT path, 'Tag' AS "Category", key AS "Property", value AS "Value" FROM {_T} x UNION ALL SELECT DISTINCT path, 'Format', 'format_name', 'literal' FROM {_T} x UNION ALL SELECT path, 'Format', 'size', CAST(count(*) AS VARCHAR) FROM {_T} x GROUP BY path""")
def report_rows(spark, d):
    return origin.report_csv(_maps(spark, d).select("path", F.lit("literal").alias("format_name"), F.size("tags").alias("size"), "tags"))
