"""Scalar functions over texts that are dealt to documents and over numeric columns of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import mixer
from ..registry import dealt, dealt_sql, inline_sql, query, table

_PDF = ["(1, 'D:20260511092633Z')", "(2, 'D:20240102')", "(3, 'D:20240102030405+05')", "(4, 'D:202401020304-08')", "(5, 'unknown')", "(6, '2023')"]
_P = "D?:?(\\d{4})(\\d{2})?(\\d{2})?(\\d{2})?(\\d{2})?(\\d{2})?\\s*(Z|[+-])?(\\d{2})?"


def _part(i: int, default: str) -> str:
    return f"coalesce(nullif(regexp_extract(s, '{_P}', {i}), ''), '{default}')"


@query(f"""SELECT id, CASE WHEN regexp_matches(s, '{_P}') THEN {_part(1, "")} || '-' || {_part(2, "01")} || '-' || {_part(3, "01")} || 'T' || {_part(4, "00")} || ':' || {_part(5, "00")} || ':' || {_part(6, "00")} ||
  CASE WHEN regexp_extract(s, '{_P}', 7) IN ('', 'Z') THEN 'Z' ELSE regexp_extract(s, '{_P}', 7) || {_part(8, "00")} || ':00' END ELSE s END AS iso FROM {dealt_sql("id, s", _PDF)}""")
def pdf_dates(spark, d):
    return dealt(spark, d, "id, s", _PDF).select("id", S.pdf_date(F.col("s")).alias("iso"))


_PLACES = ["(1, '+37.7749-122.4194+012.500/')", "(2, '-33.8688+151.2093/')", "(3, '+91.0+010.0/')", "(4, 'nowhere')", "(5, '+00.5000-000.2500-10/')"]
_I = "([+-]\\d{1,3}(?:\\.\\d+)?)([+-]\\d{1,3}(?:\\.\\d+)?)([+-]\\d+(?:\\.\\d+)?)?"
_N = lambda i: f"try_cast(nullif(regexp_extract(s, '{_I}', {i}), '') AS DOUBLE)"


@query(f"""SELECT id, CASE WHEN ok THEN lat END AS lat, CASE WHEN ok THEN lon END AS lon, CASE WHEN ok THEN alt END AS alt, CASE WHEN ok THEN CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END END AS ns
FROM (SELECT *, abs(lat) <= 90 AND abs(lon) <= 180 AS ok FROM (SELECT id, {_N(1)} AS lat, {_N(2)} AS lon, {_N(3)} AS alt FROM {dealt_sql("id, s", _PLACES)}) a) b""")
def iso6709_places(spark, d):
    p = dealt(spark, d, "id, s", _PLACES).select("id", S.iso6709(F.col("s")).alias("p"))
    return p.select("id", "p.lat", "p.lon", "p.alt", F.when(F.col("p").isNotNull(), S.hemisphere(F.col("p.lat"), "N", "S")).alias("ns"))


@query("""SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, l_linenumber, round(CASE WHEN v < 1024 THEN v WHEN v < 1048576 THEN v / 1024 WHEN v < 1073741824 THEN v / 1048576 ELSE v / 1073741824 END, 6) AS size_value,
CASE WHEN v < 1024 THEN 'B' WHEN v < 1048576 THEN 'KB' WHEN v < 1073741824 THEN 'MB' ELSE 'GB' END AS size_unit FROM (SELECT *, l_extendedprice * l_quantity * 100 AS v FROM lineitem) x""")
def size_bands(spark, d):
    v = F.col("l_extendedprice") * F.col("l_quantity") * 100
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.size_value(v), 6).alias("size_value"), S.size_unit(v).alias("size_unit"))


def _ladder(col: str, steps, rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} >= {b} THEN '{t}'" for b, t in steps) + f" ELSE '{rest}' END"


@query(f"""SELECT CAST(p_partkey AS BIGINT) AS p_partkey, {_ladder("floor(p_retailprice / 4)", S.BITRATE, "Static File")} AS bitrate, {_ladder("p_size * 2200", S.SAMPLE_RATE, "Unknown")} AS sample_rate,
CASE {" ".join(f"WHEN p_size * 90 >= {a} OR p_size * 50 >= {b} THEN '{t}'" for a, b, t in S.RESOLUTION)} ELSE 'Standard Definition (SD)' END AS resolution, {_ladder("floor(p_size * 1.5 + 0.5)", S.FRAME_RATE, "Variable Rate")} AS motion FROM part""")
def banding_ladders(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey",
        S.band(F.floor(F.col("p_retailprice") / 4), S.BITRATE, "Static File").alias("bitrate"),
        S.band(size * 2200, S.SAMPLE_RATE, "Unknown").alias("sample_rate"),
        S.resolution(size * 90, size * 50).alias("resolution"),
        S.band(S.half_up(size * 1.5), S.FRAME_RATE, "Variable Rate").alias("motion"),
    )


_CLOCKS = ["(1, '1:02:03')", "(2, '59:59')", "(3, '7')", "(4, '10:00:00.5')", "(5, '0:05')"]


@query(f"""SELECT id, total, CASE WHEN s // 3600 > 0 THEN (s // 3600) || ':' || lpad(CAST((s % 3600) // 60 AS VARCHAR), 2, '0') ELSE CAST((s % 3600) // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock FROM (
SELECT id, total, CAST(floor(total) AS BIGINT) AS s FROM (SELECT id, CASE len(p) WHEN 3 THEN CAST(p[1] AS DOUBLE) * 3600 + CAST(p[2] AS DOUBLE) * 60 + CAST(p[3] AS DOUBLE) WHEN 2 THEN CAST(p[1] AS DOUBLE) * 60 + CAST(p[2] AS DOUBLE) ELSE CAST(p[1] AS DOUBLE) END AS total
FROM (SELECT id, string_split(t, ':') AS p FROM {dealt_sql("id, t", _CLOCKS)}) a) b) c""")
def clock_texts(spark, d):
    c = dealt(spark, d, "id, t", _CLOCKS).select("id", S.parse_clock(F.col("t")).alias("total"))
    return c.select("id", "total", S.clock(F.col("total")).alias("clock"))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) + 2082844800 AS mac_seconds, o_orderdate AS back FROM orders""")
def mac_epoch(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.unix_timestamp("o_orderdate") + S.MAC_EPOCH).alias("mac_seconds"), F.col("o_orderdate").alias("__d"))
    return o.select("o_orderkey", "mac_seconds", S.mac_time(F.col("mac_seconds")).cast(o.schema["__d"].dataType).alias("back"))


@query("""SELECT vec_id, i, round(sign(x) * CASE WHEN abs(x) <= 0.7 THEN abs(x) ELSE 0.7 + 0.25 * ((exp(2 * (abs(x) - 0.7) / 0.25) - 1) / (exp(2 * (abs(x) - 0.7) / 0.25) + 1)) END, 6) AS y FROM (
SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) * 4 AS x FROM embeddings, (SELECT unnest(range(0, 64)) AS i) r) s""")
def soft_clip(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.select("vec_id", F.col("i").cast("bigint").alias("i"), F.round(S.soft_clip(F.col("v").cast("double") * 4), 6).alias("y"))


_PRESET_ROWS = [f"('{p}', '{s}', {float(g.get(s, 0.0))})" for p, g in mixer.PRESETS.items() for s in mixer.STEMS]


@query(f"""SELECT doc_id, preset, stem, CAST(db AS DOUBLE) AS db, round(CASE WHEN db <= -39.9 THEN 0.0 ELSE pow(10.0, CAST(db AS DOUBLE) / 20) END, 9) AS gain FROM documents
JOIN (SELECT * FROM {inline_sql("preset, stem, db", _PRESET_ROWS)}) p ON preset = CASE doc_id % {len(mixer.PRESETS)} {" ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(mixer.PRESETS))} END""")
def preset_gains(spark, d):
    """The gains of the preset that is dealt to each document."""
    named = F.get(F.array(*map(F.lit, mixer.PRESETS)), (F.col("doc_id") % len(mixer.PRESETS)).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", named.alias("preset"))
    return rows.join(F.broadcast(mixer.presets(spark)), "preset").select("doc_id", "preset", "stem", "db", F.round("gain", 9).alias("gain"))


_SLIDERS = "CAST(doc_id * 7 % 101 AS DOUBLE) AS nr", "CAST(doc_id % 101 AS DOUBLE) AS vb", "CAST(doc_id * 3 % 101 AS DOUBLE) AS bg"
_CUT = "CASE WHEN nr / 100.0 >= 0.95 THEN -60.0 ELSE -45.0 * pow(nr / 100.0, 1.2) END"


@query(f"""SELECT doc_id, nr, vb, bg, round(cut, 6) AS traffic, round(CASE WHEN cut <= -39.9 THEN -60.0 ELSE cut * 1.2 END, 6) AS hum, round(vb / 100.0 * 6, 6) AS main_voice, round((1 - bg / 100.0) * least(0.0, cut * 0.8), 6) AS bg_voice
FROM (SELECT *, CAST({_CUT} AS DOUBLE) AS cut FROM (SELECT doc_id, {", ".join(_SLIDERS)} FROM documents) y) x""")
def macro_curve(spark, d):
    s = table(spark, d, "documents").selectExpr("doc_id", *_SLIDERS)
    db = mixer.macro_db(F.col("nr"), F.col("vb"), F.col("bg"))
    return s.select("doc_id", "nr", "vb", "bg", *(F.round(db[k], 6).alias(k) for k in ("traffic", "hum", "main_voice", "bg_voice")))


_MIX = ["(1, 'main_voice', 1.0, false, false)", "(1, 'traffic', 0.5, true, false)", "(1, 'hum', 0.2, false, false)", "(2, 'main_voice', 1.0, false, true)", "(2, 'traffic', 0.5, true, true)", "(2, 'hum', 0.2, false, false)"]


@query(f"""SELECT mix, stem, CASE WHEN mute OR (bool_or(solo) OVER (PARTITION BY mix) AND NOT solo) THEN 0.0 ELSE CAST(value AS DOUBLE) END AS gain FROM {dealt_sql("mix, stem, value, mute, solo", _MIX)}""")
def effective_gains(spark, d):
    rows = dealt(spark, d, "mix, stem, value, mute, solo", _MIX).withColumn("value", F.col("value").cast("double"))
    return mixer.effective(rows, "mix").select("mix", "stem", "gain")


@query("""SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, greatest(25.0, least(55.0, floor(55 - (snr - 5) * 0.9 + 0.5))) AS noise_reduction, CASE WHEN -s_nationkey > -8 THEN 80 ELSE 40 END AS high_pass,
CASE WHEN -s_nationkey > -12 THEN 30 WHEN -s_nationkey > -16 THEN 20 ELSE 10 END AS de_esser, CASE WHEN snr < 20 THEN 15 ELSE 10 END AS de_reverb,
greatest(0.0, least(9.0, floor((-20 + snr) * 2 + 0.5) / 2)) AS volume FROM (SELECT *, abs(s_acctbal) / 200 AS snr FROM supplier) x""")
def recommended_settings(spark, d):
    s = table(spark, d, "supplier").withColumn("snr", F.abs("s_acctbal") / 200)
    r = mixer.recommend(F.col("snr"), -F.col("s_nationkey"), -F.col("s_nationkey"), -F.col("snr"))
    return s.select("s_suppkey", *(v.alias(k) for k, v in r.items()))
