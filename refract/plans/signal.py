"""Signal queries: embeddings serve as 64-sample recordings, events as series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signal as G
from ..registry import query, table

_X = "SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(0, 64)) AS i) r"


def _samples(spark, d):
    return G.samples(table(spark, d, "embeddings"), "vec_id", "embedding")


@query("""SELECT user_id, s[CAST(least(n - 1, floor(0.1 * n)) AS BIGINT) + 1] AS p10, s[CAST(least(n - 1, floor(0.7 * n)) AS BIGINT) + 1] AS p70, s[CAST(least(n - 1, floor(0.9 * n)) AS BIGINT) + 1] AS p90
FROM (SELECT user_id, list(value ORDER BY value) AS s, count(*) AS n FROM events GROUP BY user_id) x""")
def percentile_index(spark, d):
    return G.percentiles(table(spark, d, "events"), "user_id", "value", {"p10": 0.1, "p70": 0.7, "p90": 0.9})


@query(f"""SELECT vec_id, CAST("window" AS BIGINT) AS "window", round(energy, 6) AS energy, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY energy, "window") AS rank FROM (
SELECT vec_id, i // 4 AS "window", sum(x * x) AS energy FROM ({_X}) s GROUP BY vec_id, i // 4) e) r WHERE rank <= 6""")
def quietest_windows(spark, d):
    q = G.quietest(_samples(spark, d), "vec_id", 4, 6)
    return q.select("vec_id", F.col("window").cast("bigint").alias("window"), F.round("energy", 6).alias("energy"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH h AS (SELECT vec_id, greatest(0, least(119, CAST(floor((log10(abs(x) + 1e-12) + 6) * 12) AS BIGINT))) AS bin, count(*) AS n FROM ({_X}) s GROUP BY vec_id, bin),
c AS (SELECT *, sum(n) OVER (PARTITION BY vec_id ORDER BY bin) AS c, greatest(1, floor(0.15 * sum(n) OVER (PARTITION BY vec_id))) AS goal FROM h)
SELECT vec_id, CAST(min(bin) AS BIGINT) AS bin, round(pow(10.0, (min(bin) + 0.5) / 12 - 6), 9) AS floor FROM c WHERE c >= goal GROUP BY vec_id""")
def log_histogram_floor(spark, d):
    rows = _samples(spark, d).withColumn("x", F.abs("x"))
    return G.log_floor(rows, "vec_id").select("vec_id", F.col("bin").cast("bigint").alias("bin"), F.round("floor", 9).alias("floor"))


@query(f"""SELECT vec_id, CAST(i // 8 AS BIGINT) AS "column", least(min(x), 0.0) AS low, greatest(max(x), 0.0) AS high FROM ({_X}) s GROUP BY vec_id, i // 8""")
def waveform_minmax(spark, d):
    return G.minmax(_samples(spark, d), "vec_id", 8).withColumn("column", F.col("column").cast("bigint"))


@query(f"""SELECT vec_id, max(abs(x)) AS peak, round(sqrt(avg(x * x)), 9) AS rms, round(greatest(-90.0, 20 * log10(sqrt(avg(x * x)))), 6) AS db FROM ({_X}) s GROUP BY vec_id""")
def rms_peak(spark, d):
    return G.levels(_samples(spark, d), "vec_id").select("vec_id", "peak", F.round("rms", 9).alias("rms"), F.round("db", 6).alias("db"))


@query(f"""WITH s AS (SELECT vec_id, i, x * 8 AS x FROM ({_X}) t) SELECT vec_id, CAST(i AS BIGINT) AS i, round(x * CASE WHEN max(abs(x)) OVER (PARTITION BY vec_id) > 0.989 THEN 0.989 / max(abs(x)) OVER (PARTITION BY vec_id) ELSE 1.0 END, 9) AS x FROM s""")
def peak_guard(spark, d):
    rows = _samples(spark, d).withColumn("x", F.col("x") * 8)
    return G.guard_peaks(rows, "vec_id").select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("x", 9).alias("x"))


@query(f"""SELECT vec_id, CAST(i AS BIGINT) AS i, x FROM (SELECT *, lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS a, lead(x) OVER (PARTITION BY vec_id ORDER BY i) AS b FROM ({_X}) s) p WHERE x > a AND x > b""")
def local_peaks(spark, d):
    return G.local_peaks(_samples(spark, d), "vec_id").select("vec_id", F.col("i").cast("bigint").alias("i"), "x")


@query("""SELECT vec_id, f, round(list_sum(list_transform(embedding[f * 4 + 1:f * 4 + 16], lambda v: CAST(v AS DOUBLE))), 6) AS total, CAST(len(embedding[f * 4 + 1:f * 4 + 16]) AS BIGINT) AS n FROM embeddings, (SELECT unnest(range(0, 13)) AS f) r""")
def frame_windows(spark, d):
    f = table(spark, d, "embeddings").select("vec_id", F.posexplode(G.frames(F.transform("embedding", lambda v: v.cast("double")), 16, 4)).alias("f", "x"))
    return f.select("vec_id", F.col("f").cast("bigint").alias("f"), F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 6).alias("total"), F.size("x").cast("bigint").alias("n"))


@query("""WITH p AS (SELECT vec_id, f * 4 + i AS i, CAST(embedding[f * 4 + i + 1] AS DOUBLE) * (0.5 - 0.5 * cos(2 * pi() * i / 16)) AS y, 0.5 - 0.5 * cos(2 * pi() * i / 16) AS w FROM embeddings, (SELECT unnest(range(0, 13)) AS f) fr, (SELECT unnest(range(0, 16)) AS i) ir)
SELECT vec_id, CAST(i AS BIGINT) AS i, round(CASE WHEN sum(w * w) > 1e-4 THEN sum(y * w) / sum(w * w) ELSE sum(y * w) END, 6) AS x FROM p GROUP BY vec_id, i""")
def overlap_add(spark, d):
    f = table(spark, d, "embeddings").select("vec_id", F.posexplode(G.frames(F.transform("embedding", lambda v: v.cast("double")), 16, 4)).alias("f", "x"))
    rows = f.select("vec_id", "f", F.posexplode("x").alias("i", "v")).withColumn("w", F.get(G.hann(16), F.col("i")))
    out = G.overlap_add(rows.withColumn("y", F.col("v") * F.col("w")), "vec_id", 4)
    return out.select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


@query("""WITH RECURSIVE v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS m FROM events),
e(user_id, n, m, s) AS (SELECT user_id, n, m, value * CASE WHEN value > 0 THEN 0.85 ELSE 0.42 END FROM v WHERE n = 1
 UNION ALL SELECT v.user_id, v.n, v.m, e.s + CASE WHEN v.value > e.s THEN 0.85 ELSE 0.42 END * (v.value - e.s) FROM e JOIN v ON v.user_id = e.user_id AND v.n = e.n + 1)
SELECT user_id, round(s, 6) AS state FROM e WHERE n = m""")
def ema_attack_decay(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("v"))
    return e.select("user_id", F.round(F.element_at(G.follow(F.transform("v", lambda x: x["value"])), -1), 6).alias("state"))


def _tone_sql(k: str, n: int) -> str:
    return f"pow(sum(x * cos(2 * pi() * {k} * i / {n})), 2) + pow(sum(x * sin(2 * pi() * {k} * i / {n})), 2)"


@query(f"""SELECT vec_id, CAST(k AS BIGINT) AS k, round(sqrt({_tone_sql("k", 64)}), 6) AS magnitude FROM ({_X}) s, (SELECT unnest(range(0, 32)) AS k) b GROUP BY vec_id, k""")
def spectrum_dft(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(G.spectrum(F.col("embedding"), 64)).alias("k", "m"))
    return e.select("vec_id", F.col("k").cast("bigint").alias("k"), F.round("m", 6).alias("magnitude"))


@query(f"""SELECT vec_id, round({_tone_sql("3.5", 64)}, 6) AS power FROM ({_X}) s GROUP BY vec_id""")
def goertzel_tone(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(G.tone(F.col("embedding"), 3.5, 64), 6).alias("power"))


@query(f"""SELECT a.vec_id, CAST(a.i AS BIGINT) AS i, greatest(0.0, a.x - b.x) / 30 AS delta FROM ({_X}) a JOIN ({_X}) b ON b.vec_id = a.vec_id + 1 AND b.i = a.i""")
def delta_spectrogram(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("processed"))
    diff = F.zip_with("embedding", "processed", lambda a, b: F.greatest(F.lit(0.0), a.cast("double") - b.cast("double")) / 30)
    return e.join(after, "vec_id").select("vec_id", F.posexplode(diff).alias("i", "delta")).withColumn("i", F.col("i").cast("bigint"))


@query(f"""SELECT event_id, k, round(k * 16000 / 2048.0, 6) AS hz FROM (SELECT event_id, event_id % 1024 AS k FROM events) b WHERE {" OR ".join(f"abs(k * 16000 / 2048.0 - {t}) <= {G.HUM_WIDTH}" for t in G.HUM_HZ)}""")
def hum_band_join(spark, d):
    """Events whose frequency bin (by their id) lies at a mains tone."""
    k = F.col("event_id") % 1024
    b = table(spark, d, "events").select("event_id", k.alias("k"), (k * 16000 / 2048.0).alias("hz"))
    return b.where(G.hum_bin(F.col("hz"))).select("event_id", "k", F.round("hz", 6).alias("hz"))
