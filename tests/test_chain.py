"""The chain behind the mix: responses of its filters, curves, and segments against one piece."""

from __future__ import annotations

import numpy as np
import pytest

from refract.operators import chain
from refract.sources.audio import HOP, SEGMENT_FRAMES

RATE = 8000


def gain_at(parts, hz):
    z = np.exp(-2j * np.pi * hz / RATE)
    return np.prod([abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z)) for b, a in parts])


def test_responses():
    flat = chain.filters(RATE)
    assert gain_at(flat, 1000) == pytest.approx(1, abs=1e-3) and gain_at(flat, 1) < 0.01
    assert gain_at(chain.filters(RATE, hum_hz=60), 60) < 1e-9 and gain_at(chain.filters(RATE, hum_hz=60), 90) > 0.9
    db = lambda parts, hz: 20 * np.log10(gain_at(parts, hz))
    assert db([chain.biquad("lowshelf", 120, RATE, db=6)], 1) == pytest.approx(6, abs=0.01)
    assert db([chain.biquad("highshelf", 1000, RATE, db=-6)], RATE / 2) == pytest.approx(-6, abs=0.01)
    assert db([chain.biquad("peaking", 2500, RATE, 1.2, 4)], 2500) == pytest.approx(4)


def test_filter_equals_the_recurrence():
    x = np.random.default_rng(1).normal(size=(500, 2))
    b, a = chain.biquad("highpass", 200, RATE)
    want = np.zeros((502, 2))
    padded = np.concatenate((np.zeros((2, 2)), x))
    for n in range(2, 502):
        want[n] = (b[0] * padded[n] + b[1] * padded[n - 1] + b[2] * padded[n - 2] - a[1] * want[n - 1] - a[2] * want[n - 2]) / a[0]
    assert np.allclose(chain.filtered(x, [(b, a)], 4000), want[2:], atol=1e-9)


def test_curve_of_the_compressor():
    r = chain.reduction(np.array([-30.0, -24.0, -12.0, 0.0]), **chain.COMPRESSOR)
    assert np.allclose(r, [0, 0, 4, 12]) and np.allclose(chain.reduction(np.array([-2.0, 0.0]), **chain.LIMITER), [0, 0.95])
    assert len(chain.compressed(np.zeros((0, 1)), RATE, chain.LIMITER)) == 0
    assert np.abs(chain.soft_clip(np.array([0.5, 9.0, -9.0]))).max() <= 0.95


def test_segments_equal_one_piece(spark):
    n = SEGMENT_FRAMES * HOP
    x = (np.random.default_rng(2).normal(0, 0.2, (2 * n + 999, 2)) * np.linspace(0.1, 2, 2 * n + 999)[:, None]).astype(np.float32)
    rows = [("a", RATE, 2, i, x[lo : lo + n].ravel().tolist()) for i, lo in enumerate(range(0, len(x), n))]
    df = spark.createDataFrame(rows, "path string, sample_rate int, channels int, seg int, samples array<float>").repartition(3)
    settings = {"hum_hz": 50, "high_pass": 80, "de_esser": 30, "mid": 3}
    got = np.concatenate([np.array(r.samples) for r in chain.master(df, 3.0, **settings).orderBy("seg").collect()]).reshape(-1, 2)
    y = chain.compressed(chain.filtered(x.astype(float), chain.filters(RATE, **settings), 4 * RATE), RATE, chain.COMPRESSOR)
    want = chain.soft_clip(chain.compressed(y * 10 ** (3 / 20), RATE, chain.LIMITER))
    assert got.shape == want.shape and np.abs(got - want).max() < 1e-4
    assert chain.master(df.limit(0)).count() == 0
