"""Layers from one transform, their envelopes, and recordings that are cleaned with settings of their own."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from refract.operators import audio, chain, cleaning, layers, mixer
from refract.sources.audio import HOP, SEGMENT_FRAMES, segments, wav_bytes

RATE = 8000


def wav(seconds: float, seed: int, channels: int = 1, hum: float = 0, noise: float = 0.002) -> bytes:
    t = np.arange(int(seconds * RATE)) / RATE
    x = np.random.default_rng(seed).normal(0, noise, len(t)) + 0.3 * np.sin(2 * np.pi * 440 * t) * (np.sin(2 * np.pi * t) > 0)
    if hum:
        x += sum(0.03 / h * np.sin(2 * np.pi * hum * h * t) for h in (1, 2, 3))
    return wav_bytes(np.stack([x * (1 - 0.2 * c) for c in range(channels)], axis=1), RATE)


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a", wav(70, 1)), ("b", wav(3, 2, 2)), ("c", wav(9, 3, hum=50)), ("d", wav(9, 4, hum=60, noise=0.02)), ("short", wav(0.1, 5)), ("none", b"text"), ("null", None)]
    return spark.createDataFrame([(p, bytearray(b) if b else b) for p, b in rows], "path string, content binary").repartition(3).cache()


def test_layers_add_up_over_segments(spark, files):
    """Two segments of the long recording: the layers' sum is the mix at unity, which is the recording."""
    cut = segments(files)
    floors = audio.noise_floor(cut)
    made = audio.layers(cut, floors).where("path IN ('a', 'b')").orderBy("path", "seg").collect()
    whole = {(r.path, r.seg): np.array(r.samples) for r in audio.mix(cut, floors, {}).collect()}
    assert [(r.path, r.seg, r.n_segs) for r in made] == [("a", 0, 2), ("a", 1, 2), ("b", 0, 1)]
    for r in made:
        total = np.sum([np.array(x) for x in r.layers], axis=0)
        assert np.abs(total - whole[r.path, r.seg]).max() < 1e-5


def test_pyramid_equals_brute_force(spark, monkeypatch):
    """Several segments that share the cells of upper levels; every level against the samples."""
    own = SEGMENT_FRAMES * HOP
    r = np.random.default_rng(3)
    n = 2 * own + 70_001
    x = r.normal(size=(9, n)).astype(np.float32)
    rows = [("p", RATE, 1, i, 3, [v[i * own : (i + 1) * own].tolist() for v in x]) for i in range(3)]
    df = spark.createDataFrame(rows, "path string, sample_rate int, channels int, seg int, n_segs int, layers array<array<float>>").repartition(3)
    got = layers.pyramid(df).collect()
    sizes = {level: layers.CELL * layers.STEP**level for level in {c.level for c in got}}
    assert max(sizes.values()) >= n and len(sizes) > 6
    for level, size in sizes.items():
        cells = {c.cell: c for c in got if c.level == level}
        assert sorted(cells) == list(range(-(-n // size)))
        for k in range(0, len(cells), 17):
            part = x[:, k * size : (k + 1) * size]
            assert np.allclose(cells[k].low, part.min(axis=1)) and np.allclose(cells[k].high, part.max(axis=1))
    gains = [0.0, 1.0, 0.5, 2.0, 0, 0, 0, 1.0, 0.25]
    env = {(c.level, c.cell): c for c in layers.envelope(layers.pyramid(df), F.array(*map(F.lit, map(float, gains)))).where("level > 5").collect()}
    for (level, cell), c in env.items():
        part = x[:, cell * sizes[level] : (cell + 1) * sizes[level]]
        assert c.low == pytest.approx(sum(g * v for g, v in zip(gains, part.min(axis=1)))) and c.high == pytest.approx(sum(g * v for g, v in zip(gains, part.max(axis=1))))


def test_settings_of_each_recording(spark, files):
    """One plan with a column of settings equals one plan for each setting."""
    cut = segments(files.where("path IN ('b', 'c', 'd')"))
    floors = audio.noise_floor(cut)
    own = {"b": (80.0, 0.0, 3.0), "c": (40.0, 50.0, 0.0), "d": (None, 60.0, None)}
    settings = spark.createDataFrame([(p, v) for p, v in own.items()], "path string, settings struct<high_pass:double,hum_hz:double,volume_db:double>")
    gains = F.when(F.col("path") == "b", F.array(*[F.lit(1.0)] * 9)).otherwise(F.array(*[F.lit(0.5)] * 9))
    got = {r.path: np.array(r.samples) for r in chain.master(audio.mix(cut, floors.join(settings, "path").withColumn("gains", gains))).collect()}
    for p, (hp, hum, volume) in own.items():
        mixed = audio.mix(cut.where(F.col("path") == p), floors, {s: 1.0 if p == "b" else 0.5 for s in mixer.STEMS})
        want = chain.master(mixed, volume or 0.0, high_pass=hp or 0, hum_hz=hum).first().samples
        assert np.allclose(got[p], want, atol=1e-6)


def test_recommendations(spark):
    rows = [("clean", 50.0, -20.0, -20.0, -20.0, 0), ("noisy", 5.0, -3.0, -5.0, -35.0, 60), ("unknown", None, None, None, None, None)]
    got = {r.path: r for r in cleaning.recommended(spark.createDataFrame(rows, "path string, snr_db double, rumble_db double, sibilance_db double, speech_db double, hum_hz int")).collect()}
    hum, reverb, music = (mixer.STEMS.index(k) for k in ("hum", "reverb", "music"))
    assert (got["clean"].settings.high_pass, got["clean"].settings.de_esser, got["clean"].settings.volume_db, got["clean"].settings.hum_hz) == (40, 10, 0, 0)
    assert (got["noisy"].settings.high_pass, got["noisy"].settings.de_esser, got["noisy"].settings.volume_db, got["noisy"].settings.hum_hz) == (80, 30, 9, 60)
    assert (got["unknown"].settings.high_pass, got["unknown"].settings.de_esser, got["unknown"].settings.volume_db) == (40, 15, 0)
    assert got["noisy"].gains[hum] == pytest.approx(10**-1.5) and got["clean"].gains[music] == pytest.approx(10**-0.3)
    assert got["noisy"].gains[reverb] == pytest.approx(10 ** (-0.42 * 15 / 20)) and got["noisy"].gains[2] < got["clean"].gains[2]


def test_automatic_cleaning_of_anything(spark, files):
    """Recordings under one frame and what isn't sound have no rows; hum is found and notched."""
    done = {(r.path, r.seg): r for r in cleaning.automatic(files, 2.0).collect()}
    assert sorted(done) == [("a", 0), ("a", 1), ("b", 0), ("c", 0), ("d", 0)]
    t = np.arange(9 * RATE) / RATE
    before = np.frombuffer(wav(9, 3, hum=50)[44:], "<i2") / 32768
    tone = lambda x: abs(np.exp(-2j * np.pi * 50 * t) @ x)
    assert tone(np.array(done["c", 0].samples)) < 0.1 * tone(before)
    assert cleaning.automatic_wav(files.limit(0)).count() == 0


def whole(df, channels):
    return np.concatenate([np.array(r.samples) for r in df.orderBy("seg").collect()]).reshape(-1, channels)


@pytest.mark.parametrize("to", [16_000, 5_000, 7_999, 44_100])
def test_resampled_pieces_equal_one_run(spark, to):
    """Segments against the whole recording; a tone keeps its frequency and level, and images stay under -80 dB."""
    n = 2 * SEGMENT_FRAMES * HOP // 32 + 777  # segments of 32 frames
    t = np.arange(n) / RATE
    x = np.stack([0.5 * np.sin(2 * np.pi * 1000 * t), 0.25 * np.sin(2 * np.pi * 333 * t)], axis=1)
    df = spark.createDataFrame([("a", bytearray(wav_bytes(x, RATE, 24)))], "path string, content binary")
    frames = SEGMENT_FRAMES // 32
    cut = segments(df, frames)
    pieces = []
    for r in cut.orderBy("seg").collect():
        lo, hi = r.seg * frames * HOP, min(r.n_samples, (r.seg + 1) * frames * HOP)
        y = np.asarray(r.samples, float).reshape(-1, 2)
        pieces.append(audio.resampled(y, r.start, -(-lo * to // RATE), -(-hi * to // RATE), RATE, to))
    got = np.concatenate(pieces)
    assert np.abs(got - audio.resampled(x, 0, 0, -(-n * to // RATE), RATE, to)).max() < 1e-6
    assert len(got) == -(-n * to // RATE)
    inner = got[to // 2 : -to // 2, 0]
    at = np.arange(len(inner)) / to
    w = np.kaiser(len(inner), 14)
    tone = 2 * abs(np.exp(-2j * np.pi * 1000 * at) @ (inner * w)) / w.sum()
    spectrum = 20 * np.log10(np.abs(np.fft.rfft(inner * w)) / (w.sum() / 2) + 1e-12)
    hz = np.fft.rfftfreq(len(inner), 1 / to)
    assert abs(20 * np.log10(tone / 0.5)) < 0.01
    assert spectrum[np.abs(hz - 1000) > 20].max() < -80 + 20 * np.log10(0.5)


def test_resampling_of_files(spark, files):
    cut = segments(files.where("path IN ('a', 'b')"))
    got = {(r.path, r.seg): len(r.samples) // r.channels for r in audio.resample(cut, 4000).collect()}
    assert got == {("a", 0): SEGMENT_FRAMES * HOP // 2, ("a", 1): (70 * RATE - SEGMENT_FRAMES * HOP) // 2, ("b", 0): 3 * RATE // 2}
    same = audio.resample(cut.where("path = 'b'"), RATE)
    assert np.allclose(whole(same, 2), np.frombuffer(wav(3, 2, 2)[44:], "<i2").reshape(-1, 2) / 32768, atol=1e-6)
    assert audio.resample(cut.limit(0), 4000).count() == 0


def test_spectrogram_equals_a_whole_run(spark, files):
    """Columns and rows by maximum over all frames of the recording, whatever segments they lie in."""
    row = files.where("path = 'a'").first()
    x = np.frombuffer(bytes(row.content)[44:], "<i2").astype(np.float32) / 32768
    frames = np.lib.stride_tricks.sliding_window_view(x, 2048)[::HOP]
    m = np.abs(np.fft.rfft(frames * audio.HANN, axis=1))[:, : audio.HALF]
    per = -(-len(m) // 100)
    edge = np.unique((audio.HALF * (np.arange(audio.SPECTRUM_ROWS) / audio.SPECTRUM_ROWS) ** audio.BEND).astype(int))
    got = audio.spectrogram(segments(files.where("path = 'a'")), 100).collect()
    cols = sorted({r.col for r in got})
    assert cols == list(range(-(-len(m) // per))) and len(got) == len(cols) * len(edge)
    rows = sorted({r.row for r in got})
    cells = {(r.col, r.row): r.db for r in got}
    for c in cols[::9]:
        part = m[c * per : (c + 1) * per]
        for i in range(0, len(edge), 11):
            hi = edge[i + 1] if i + 1 < len(edge) else audio.HALF
            assert cells[c, rows[i]] == pytest.approx(max(-120, 20 * np.log10(part[:, edge[i] : hi].max() + 1e-12)), abs=1e-3)
