"""Media queries over recordings that are built from table rows, so their expected facts are known."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.scalars import gain
from ..operators import audio, layers, media, mixer
from ..registry import query, table
from ..sources.audio import segments, slow_windows, wav_bytes
from ..sources.containers import boxes

RATE, SECONDS = 16_000, 3


def recordings(spark, d):
    """One WAV file a nation: bursts of a tone of 300 + 20 * key Hz over steady noise; mono or stereo by key."""

    def make(batches):
        for part in batches:
            rows = []
            for key in part.n_nationkey:
                n = RATE * (SECONDS + int(key) % 3)
                t = np.arange(n) / RATE
                noise = np.random.Generator(np.random.PCG64(int(key))).normal(0, 0.01, n)
                x = noise + 0.4 * np.sin(2 * np.pi * (300 + 20 * int(key)) * t) * (np.sin(2 * np.pi * t) > 0)
                rows.append((f"nation-{key}.wav", "wav", wav_bytes(np.stack([x] * (1 + int(key) % 2), axis=1), RATE)))
            yield pd.DataFrame(rows, columns=["path", "format", "content"])

    return table(spark, d, "nation").select("n_nationkey").mapInPandas(make, "path string, format string, content binary")


@query("""SELECT 'nation-' || n_nationkey || '.wav' AS path, 'pcm_s16le' AS codec, CAST(1 + n_nationkey % 2 AS BIGINT) AS channels, CAST(16000 AS BIGINT) AS sample_rate, CAST(16 AS BIGINT) AS bits, CAST(3 + n_nationkey % 3 AS DOUBLE) AS duration FROM nation""")
def wav_streams(spark, d):
    return media.wav_streams(boxes(recordings(spark, d)))


@query("""SELECT 'nation-' || n_nationkey || '.wav' AS path, b.box, CAST(CASE WHEN b.box = 'fmt ' THEN 24 ELSE 8 + 16000 * (3 + n_nationkey % 3) * (1 + n_nationkey % 2) * 2 END AS BIGINT) AS size FROM nation, (VALUES ('fmt '), ('data')) AS b(box)""")
def wav_boxes(spark, d):
    return boxes(recordings(spark, d)).select("path", "box", "size")


@query()
def recording_analysis(spark, d):
    return audio.analyse(segments(recordings(spark, d)))


@query()
def noise_profile(spark, d):
    floors = audio.noise_floor(segments(recordings(spark, d)))
    return floors.select("path", F.posexplode("floor").alias("bin", "floor"))


@query()
def stem_energy(spark, d):
    s = segments(recordings(spark, d))
    return audio.stem_energy(s, audio.noise_floor(s))


@query()
def clean_mix(spark, d):
    """The recordings with the gains of a preset, as WAV segments."""
    s = segments(recordings(spark, d))
    gains = F.array(*(gain(F.lit(mixer.PRESETS["voice_only"].get(k, 0.0))) for k in mixer.STEMS))
    out = audio.to_wav(audio.mix(s, audio.noise_floor(s).withColumn("gains", gains)))
    return out.select("path", "seg", F.octet_length("content").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


@query("""SELECT path, level, CAST((n + c - 1) // c AS BIGINT) AS cells, true AS adds_up, true AS inside FROM (SELECT 'nation-' || n_nationkey || '.wav' AS path, 16000 * (3 + n_nationkey % 3) AS n FROM nation) r,
(SELECT CAST(l AS INT) AS level, CAST(512 * pow(4, l) AS BIGINT) AS c FROM (SELECT unnest(range(0, 6)) AS l) x) s WHERE level = 0 OR c // 4 < n""")
def layer_envelope(spark, d):
    """Cells of the layers' envelopes by level; whether the layers add up to the recording where frames cover it whole, and
    whether the mix of a preset stays inside its envelope."""
    cut = segments(recordings(spark, d))
    made = audio.layers(cut, audio.noise_floor(cut))
    gains = F.array(*(F.lit(10.0 ** (mixer.PRESETS["dry_voice"].get(s, 0.0) / 20)) for s in mixer.STEMS))
    cells = layers.envelope(layers.pyramid(made), gains)
    per = cells.groupBy("path", "level").agg(F.count(F.lit(1)).alias("cells"), F.min("low").alias("low"), F.max("high").alias("high"))

    def compare(batches):
        g = np.array([10.0 ** (mixer.PRESETS["dry_voice"].get(s, 0.0) / 20) for s in mixer.STEMS])
        for part in batches:
            rows = []
            for r in part.itertuples():
                x, y = np.stack([np.asarray(v) for v in r.layers]), np.asarray(r.samples)
                whole = slice(2048 * r.channels, -2048 * r.channels)
                mix = g @ x
                rows.append((r.path, bool(np.abs(x.sum(axis=0)[whole] - y[: x.shape[1]][whole]).max() < 1e-4), float(mix.min()), float(mix.max())))
            yield pd.DataFrame(rows, columns=["path", "adds_up", "least", "most"])

    told = made.join(cut.select("path", "seg", "samples"), ["path", "seg"]).mapInPandas(compare, "path string, adds_up boolean, least double, most double")
    return per.join(told, "path").select("path", "level", "cells", "adds_up", ((F.col("low") <= F.col("least") + 1e-6) & (F.col("high") >= F.col("most") - 1e-6)).alias("inside"))


@query("""SELECT 'nation-' || n_nationkey || '.wav' AS path, 0 AS hum_hz, 0.0::DOUBLE AS hum_db FROM nation""")
def mains_hum(spark, d):
    """These recordings have no mains tone (``mains_tones`` has recordings with one)."""
    return audio.hum(slow_windows(recordings(spark, d), 1.0))


@query("""SELECT 'nation-' || n_nationkey || '.wav' AS path, r.rate, CAST(r.rate * (3 + n_nationkey % 3) AS BIGINT) AS n, 1 + n_nationkey % 2 AS channels, true AS same_tone, true AS same_level FROM nation, (VALUES (8000), (22050), (16000)) AS r(rate)""")
def resampled_tones(spark, d):
    """Recordings at other rates: how long they are, and whether their tone keeps its frequency and its level within 0.1 dB."""
    cut = segments(recordings(spark, d))

    def listen(batches):
        for part in batches:
            rows = []
            for r in part.itertuples():
                x = np.asarray(r.samples, float).reshape(-1, r.channels)[:, 0]
                hz = 300 + 20 * int(r.path.split("-")[1][:-4])
                t = np.arange(len(x)) / r.sample_rate
                level = lambda f: 2 * abs(np.exp(-2j * np.pi * f * t) @ x) / len(x)  # noqa: B023, E731
                rows.append((r.path, r.sample_rate, len(x), r.channels, level(hz) > 20 * max(level(hz - 7.3), level(hz + 7.3)), bool(abs(20 * np.log10(level(hz) / 0.2)) < 0.1)))
            yield pd.DataFrame(rows, columns=["path", "rate", "n", "channels", "same_tone", "same_level"])

    kinds = "path string, rate int, n bigint, channels int, same_tone boolean, same_level boolean"
    made = [audio.resample(cut, rate).mapInPandas(listen, kinds) for rate in (8000, 22050, 16000)]
    return made[0].union(made[1]).union(made[2])


@query("""SELECT 'nation-' || n_nationkey || '.wav' AS path, CAST((16000 * (3 + n_nationkey % 3) - 2048) // 512 + 1 AS BIGINT) AS cols, true AS at_tone FROM nation""")
def spectrogram_peaks(spark, d):
    """Columns of each recording's spectrogram, and whether its loudest row is the one that holds its tone."""
    s = audio.spectrogram(segments(recordings(spark, d)), 10_000)
    g = s.groupBy("path").agg(F.count_distinct("col").alias("cols"), F.max_by("row", "db").alias("row"))
    hz = 300 + 20 * F.regexp_extract("path", r"(\d+)", 1).cast("int")
    first = lambda r: F.floor(F.lit(audio.HALF) * F.pow(r / F.lit(float(audio.SPECTRUM_ROWS)), F.lit(audio.BEND)))
    at = F.floor(hz * 2048 / 16000 + 0.5)
    return g.select("path", "cols", ((first(F.col("row")) <= at + 1) & (first(F.col("row") + 3) >= at - 1)).alias("at_tone"))
