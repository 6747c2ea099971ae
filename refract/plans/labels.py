"""Queries of words for levels, layers, streams and boxes, and of the chain behind the mix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.scalars import SAMPLE_RATE, band
from ..operators import audio, chain, cleaning, mixer, streams
from ..registry import query, table
from ..sources.audio import segments, slow_windows, wav_bytes
from .files import made

_STEMS = "[" + ", ".join(f"'{s}'" for s in mixer.STEMS) + "]"
_LAYERS = f"SELECT s_suppkey, {_STEMS}[s_suppkey % 9 + 1] AS stem, abs(s_acctbal) / 5000 AS gain, s_nationkey % 7 = 0 AS mute, s_nationkey % 11 = 1 AS solo FROM supplier"
_DB = "CASE WHEN {0} <= 0 THEN -40 ELSE floor(200 * log10({0}) + 0.5) / 10 END"


@query(f"""SELECT s_suppkey, stem, db, CASE WHEN mute THEN 'MUTED (OFF)' WHEN solo THEN 'SOLO (' || text || ')' WHEN stem = 'bg_voice' AND db >= -1 THEN printf('%.1f dB', db) || ' (100% PRESERVED)' WHEN db > 0.5 THEN text || ' (BOOSTED)'
WHEN db <= -6 THEN text || ' (-' || least(99, CAST(floor((1 - gain) * 100 + 0.5) AS BIGINT)) || '%)' ELSE text END AS status FROM (SELECT *, CASE WHEN db > 0 THEN '+' ELSE '' END || printf('%.1f dB', db) AS text FROM (SELECT *, CAST({_DB.format("gain")} AS DOUBLE) AS db FROM ({_LAYERS}) a) b) c""")
def layer_status(spark, d):
    stem = F.get(F.array(*map(F.lit, mixer.STEMS)), (F.col("s_suppkey") % 9).cast("int"))
    rows = table(spark, d, "supplier").select("s_suppkey", stem.alias("stem"), (F.abs("s_acctbal") / 5000).alias("gain"), (F.col("s_nationkey") % 7 == 0).alias("mute"), (F.col("s_nationkey") % 11 == 1).alias("solo"))
    return rows.select("s_suppkey", "stem", labels.decibels(F.col("gain")).alias("db"), labels.layer_status(*(F.col(c) for c in ("stem", "gain", "mute", "solo"))).alias("status"))


@query(f"""SELECT s_suppkey, round(mean, 9) AS mean, CAST({_DB.format("mean")} AS DOUBLE) AS db, greatest(0, least(99, CAST(floor((1 - mean) * 100 + 0.5) AS INT))) AS percent,
greatest(0.0::DOUBLE, floor((CAST({_DB.format("voice")} AS DOUBLE) - CAST({_DB.format("mean")} AS DOUBLE)) * 10 + 0.5) / 10) AS contrast FROM (SELECT s_suppkey, (s_nationkey / 25.0::DOUBLE + s_suppkey % 10 / 10.0::DOUBLE + 0.25::DOUBLE) / 3 AS mean, 1.5::DOUBLE AS voice FROM supplier) x""")
def noise_cut(spark, d):
    r = labels.noise_cut(F.col("s_nationkey") / 25, F.col("s_suppkey") % 10 / 10, F.lit(0.25), F.lit(1.5))
    s = table(spark, d, "supplier").select("s_suppkey", *(v.alias(k) for k, v in r.items()))
    return s.withColumn("mean", F.round("mean", 9))


@query("""SELECT p_partkey, hz, CASE WHEN hz <= 65 THEN 'Sub-bass / Hum' WHEN hz <= 220 THEN 'Traffic / Engine Rumble' WHEN hz <= 3500 THEN 'Vocal Formants / Speech' WHEN hz <= 7000 THEN 'Presence / Fan Whine' ELSE 'Hiss / Air' END AS band
FROM (SELECT p_partkey, CAST(floor(pow(p_size / 50.0::DOUBLE, 1.8) * 16000) AS BIGINT) AS hz FROM part) x""")
def acoustic_bands(spark, d):
    p = table(spark, d, "part").select("p_partkey", labels.pitch_at(F.col("p_size") / 50, F.lit(16000)).alias("hz"))
    return p.withColumn("band", labels.acoustic(F.col("hz")))


@query("""SELECT o_orderkey, printf('%02d:%02d.%03d', CAST(floor(s / 60) AS BIGINT), CAST(floor(s % 60) AS BIGINT), CAST(floor((s % 1) * 1000) AS BIGINT)) AS text FROM (SELECT o_orderkey, o_totalprice / 64 AS s FROM orders) x""")
def clock_ms(spark, d):
    return table(spark, d, "orders").select("o_orderkey", labels.clock_ms(F.col("o_totalprice") / 64).alias("text"))


@query("""SELECT n_nationkey || '.mp4' AS path, b.top, b.role, 'MP4 Video Container' AS name FROM nation, (VALUES ('ftyp', 'Identity Badge'), ('moov', 'Timeline & Index'), ('mdat', 'Raw Media Payload')) AS b(top, role)""")
def box_roles(spark, d):
    b = made(spark, d, "mp4").select("path", F.substring_index("box", ".", 1).alias("top"), labels.box_role(F.col("box")).alias("role"), labels.format_name(F.col("path"), F.lit(None).cast("string")).alias("name"))
    return b.distinct()


@query("""SELECT n_nationkey || '.mp4' AS path, 'video' AS kind, 'Universal Video Standard' AS codec, 'Unknown' AS channels, 'Standard CD Precision' AS depth, 'Unknown' AS rate FROM nation UNION ALL
SELECT n_nationkey || '.mp4', 'audio', 'Modern High-Efficiency', CASE n_nationkey % 2 WHEN 0 THEN 'Single Audio Source' ELSE 'Left & Right Ear Experience' END, 'Standard CD Precision', CASE n_nationkey % 3 WHEN 0 THEN 'Pro Video / Film Standard' WHEN 1 THEN 'CD Master Quality' ELSE 'Voice / Speech Clarity' END FROM nation""")
def stream_badges(spark, d):
    s = streams.mp4_streams(made(spark, d, "mp4"))
    codec = F.when(F.col("kind") == "video", labels.video_codec(F.col("codec"))).otherwise(labels.audio_codec(F.col("codec")))
    return s.select("path", "kind", codec.alias("codec"), labels.channels(F.col("channels")).alias("channels"), labels.depth(F.col("bits"), F.lit(False)).alias("depth"), band(F.col("sample_rate"), SAMPLE_RATE, "Unknown").alias("rate"))


RATE = 8000


def hums(spark, d):
    """Recordings of 6 seconds: a mains tone with two harmonics of 50 or 60 Hz by key, every third one without."""

    def make(batches):
        for part in batches:
            rows = []
            for key in map(int, part.n_nationkey):
                t = np.arange(6 * RATE) / RATE
                x = np.random.Generator(np.random.PCG64(key)).normal(0, 0.002, len(t))
                for h in (1, 2, 3) if key % 3 else ():
                    x += 0.1 / h * np.sin(2 * np.pi * (40 + 10 * (key % 3)) * h * t)
                rows.append((f"hum-{key}.wav", "wav", wav_bytes(x[:, None], RATE)))
            yield pd.DataFrame(rows, columns=["path", "format", "content"])

    return table(spark, d, "nation").select("n_nationkey").mapInPandas(make, "path string, format string, content binary")


@query("""SELECT 'hum-' || n_nationkey || '.wav' AS path, CASE n_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 50 ELSE 60 END AS hum_hz, n_nationkey % 3 > 0 AS heard FROM nation""")
def mains_tones(spark, d):
    h = audio.hum(slow_windows(hums(spark, d), 2.0))
    return h.select("path", "hum_hz", (F.col("hum_db") > 0).alias("heard"))


@query("""SELECT 'hum-' || n_nationkey || '.wav' AS path, CASE WHEN n_nationkey % 3 > 0 THEN true END AS quieter, true AS within FROM nation""")
def de_hum(spark, d):
    """Whether the chain's notch takes the mains tone out (null: there was none), and samples stay within full scale."""
    files = hums(spark, d)
    cut, key = segments(files), F.regexp_extract("path", r"(\d+)", 1).cast("int") % 3
    hz = F.get(F.array(*map(F.lit, (50.0, 50.0, 60.0))), key)
    # Each recording comes twice, with the notch at its own frequency and without.
    named = audio.noise_floor(cut).withColumn("gains", F.array(*[F.lit(1.0)] * len(mixer.STEMS)))
    both = audio.mix(cut, named).select("*", F.explode(F.array(F.lit(0.0), hz)).alias("hz")).withColumn("settings", F.struct(F.col("hz").alias("hum_hz"))).withColumn("path", F.concat_ws("|", "path", F.col("hz") > 0))
    done = chain.master(both, compress=False)
    power = F.aggregate(F.slice("samples", RATE, RATE), F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    level = done.groupBy("path").agg(F.avg(power).alias("level"), F.max(F.array_max(F.transform("samples", F.abs))).alias("peak"))
    of = lambda k: F.max(F.when(F.substring_index("path", "|", -1) == k, F.col("level")))
    name = F.substring_index("path", "|", 1).alias("path")
    told = level.groupBy(name).agg(of("true").alias("cut"), of("false").alias("plain"), F.max("peak").alias("peak"))
    quieter = F.when(F.regexp_extract("path", r"(\d+)", 1).cast("int") % 3 > 0, F.col("cut") < F.col("plain"))
    return told.select("path", quieter.alias("quieter"), (F.col("peak") <= 1).alias("within"))


def spoken(spark, d):
    """Recordings of 10 seconds: bursts of a low voice over noise that grows with the key, mains hum by key as in ``hums``."""

    def make(batches):
        for part in batches:
            rows = []
            for key in map(int, part.n_nationkey):
                t = np.arange(10 * RATE) / RATE
                burst = np.sqrt(np.maximum(0, np.sin(2 * np.pi * 0.5 * t)))
                x = 0.06 * burst * sum(np.sin(2 * np.pi * 140 * h * t) / h for h in range(1, 12))
                x += np.random.Generator(np.random.PCG64(key)).normal(0, 0.0002 if key % 2 else 0.006, len(t))
                for h in (1, 2, 3) if key % 3 else ():
                    x += 0.02 / h * np.sin(2 * np.pi * (40 + 10 * (key % 3)) * h * t)
                rows.append((f"voice-{key}.wav", "wav", wav_bytes(x[:, None], RATE)))
            yield pd.DataFrame(rows, columns=["path", "format", "content"])

    return table(spark, d, "nation").select("n_nationkey").mapInPandas(make, "path string, format string, content binary")


@query("""SELECT 'voice-' || n_nationkey || '.wav' AS path, CASE n_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 50 ELSE 60 END AS hum_hz, n_nationkey % 2 = 0 OR n_nationkey % 3 > 0 AS harder, true AS voice_kept, CASE WHEN n_nationkey % 3 > 0 THEN true END AS pauses_quieter, CASE WHEN n_nationkey % 3 > 0 THEN true END AS hum_gone, true AS within FROM nation""")
def auto_clean(spark, d):
    """Each recording's own settings and what they did: the voice stays within 6 dB of the volume that was added, pauses
    with hum lose 6 dB at least against the voice, the mains tone 15 dB, and peaks stay under the guard."""
    files = spoken(spark, d)
    own = cleaning.recommended(cleaning.measured(files, 2.0)).select("path", F.col("settings.hum_hz").cast("int").alias("hum_hz"), F.col("settings.volume_db").alias("volume"), (F.get("gains", mixer.STEMS.index("traffic")) < 0.2).alias("harder"))
    wav = cleaning.automatic_wav(files, 2.0)

    def heard(batches):
        for part in batches:
            rows = []
            for path, content in zip(part.path, part.content):
                x = np.frombuffer(content[44:], "<i2") / 32768
                t = np.arange(len(x)) / RATE
                e = np.sin(2 * np.pi * 0.5 * t)
                hz = 40 + 10 * (int(path.split("-")[1][:-4]) % 3)
                tone = lambda f: abs(np.exp(-2j * np.pi * f * t) @ x) / len(x)  # noqa: B023, E731
                rows.append((path, float((x[e > 0.5] ** 2).mean()), float((x[(e < -0.3) & (t > 1)] ** 2).mean()), float(tone(hz)), float(np.abs(x).max())))
            yield pd.DataFrame(rows, columns=["path", "voice", "pause", "tone", "peak"])

    kinds = "path string, voice double, pause double, tone double, peak double"
    before, after = files.select("path", "content").mapInPandas(heard, kinds), wav.select("path", "content").mapInPandas(heard, kinds)
    db = lambda c, k=10: k * F.log10(F.col(f"a.{c}") / F.col(f"b.{c}"))
    j = after.alias("a").join(before.alias("b"), "path").join(own, "path")
    return j.select(
        "path", "hum_hz", "harder", (F.abs(db("voice") - F.col("volume")) < 6).alias("voice_kept"), F.when(F.col("hum_hz") > 0, db("pause") - db("voice") < -6).alias("pauses_quieter"),
        F.when(F.col("hum_hz") > 0, db("tone", 20) - F.col("volume") < -15).alias("hum_gone"), (F.col("a.peak") <= 0.99).alias("within"),
    )
