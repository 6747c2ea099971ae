"""The chain behind the mix: filters, compressor, limiter and soft clipping, segment by segment.

Filters and followers forget: a segment is run together with WARM_SECONDS before it, after which what came earlier
counts for less than a millionth, so a recording of any length stays as many independent tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.audio import HOP, SEGMENT_FRAMES

WARM_SECONDS, STEPS_A_SECOND = 2, 1000
# Settings of the filters, of the compressor and of the limiter (dB, seconds).
HIGH_PASS, NOTCH_Q, DE_ESSER, LOW, MID, HIGH = (20, 0.707), 14.0, (6800, 1.8, 15.0), 120, (2500, 1.2), 8000
COMPRESSOR = {"threshold": -24.0, "knee": 12.0, "ratio": 3.0, "attack": 0.01, "release": 0.15}
LIMITER = {"threshold": -1.0, "knee": 0.0, "ratio": 20.0, "attack": 0.001, "release": 0.08}
KNEE, ROOM = 0.7, 0.25


def biquad(kind: str, hz: float, rate: int, q: float = 0.707, db: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of the usual second-order filters; shelves have a slope of one."""
    w = 2 * math.pi * min(hz, 0.49 * rate) / rate
    c, a = math.cos(w), 10 ** (db / 40)
    alpha = math.sin(w) / (2 * (q if kind not in ("lowshelf", "highshelf") else 1 / math.sqrt(2)))
    if kind == "highpass":
        b, d = [(1 + c) / 2, -1 - c, (1 + c) / 2], [1 + alpha, -2 * c, 1 - alpha]
    elif kind == "notch":
        b, d = [1, -2 * c, 1], [1 + alpha, -2 * c, 1 - alpha]
    elif kind == "peaking":
        b, d = [1 + alpha * a, -2 * c, 1 - alpha * a], [1 + alpha / a, -2 * c, 1 - alpha / a]
    else:
        s = 1 if kind == "lowshelf" else -1
        r = 2 * math.sqrt(a) * alpha
        b = [a * (a + 1 - s * (a - 1) * c + r), s * 2 * a * (a - 1 - s * (a + 1) * c), a * (a + 1 - s * (a - 1) * c - r)]
        d = [a + 1 + s * (a - 1) * c + r, -s * 2 * (a - 1 + s * (a + 1) * c), a + 1 + s * (a - 1) * c - r]
    return np.array(b, float), np.array(d, float)


def filters(rate: int, high_pass: float = 0, hum_hz: float = 0, de_esser: float = 0, low: float = 0, mid: float = 0, high: float = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    out = [biquad("highpass", high_pass or HIGH_PASS[0], rate, HIGH_PASS[1])]
    if hum_hz:
        out.append(biquad("notch", hum_hz, rate, NOTCH_Q))
    out.append(biquad("peaking", DE_ESSER[0], rate, DE_ESSER[1], -de_esser / 100 * DE_ESSER[2]))
    return [*out, biquad("lowshelf", LOW, rate, db=low), biquad("peaking", MID[0], rate, MID[1], mid), biquad("highshelf", HIGH, rate, db=high)]


def filtered(x: np.ndarray, parts: list, tail: int) -> np.ndarray:
    """The filters' product on the columns of x: one transform, with room for ``tail`` samples to die away."""
    n = 1 << (len(x) + tail - 1).bit_length()
    z = np.exp(-2j * np.pi * np.arange(n // 2 + 1) / n)
    response = np.prod([np.polyval(b[::-1], z) / np.polyval(a[::-1], z) for b, a in parts], axis=0)
    return np.fft.irfft(np.fft.rfft(x, n, axis=0) * response[:, None], n, axis=0)[: len(x)]


def reduction(db: np.ndarray, threshold: float, knee: float, ratio: float, **_) -> np.ndarray:
    """dB that a level is lowered by: none below the threshold, a parabola over the knee, then the ratio."""
    over = db - threshold
    inside = np.clip(over, 0, knee) ** 2 / (2 * knee) if knee else 0
    return (1 - 1 / ratio) * (inside + np.maximum(over - knee, 0))


def compressed(x: np.ndarray, rate: int, settings: dict) -> np.ndarray:
    """x lowered by its level, followed in steps of a millisecond, and raised by 0.6 of what full scale is lowered by."""
    step = max(1, rate // STEPS_A_SECOND)
    peaks = np.abs(np.pad(x, ((0, -len(x) % step), (0, 0)))).max(axis=1).reshape(-1, step).max(axis=1) if len(x) else np.zeros(0)
    goal = reduction(20 * np.log10(peaks + 1e-9), **settings)
    up, down = (1 - math.exp(-step / rate / settings[k]) for k in ("attack", "release"))
    state, states = 0.0, [0.0]
    for g in goal.tolist():
        state += (up if g > state else down) * (g - state)
        states.append(state)
    now = np.interp(np.arange(len(x)), np.arange(len(states)) * step, states)
    makeup = 0.6 * float(reduction(np.zeros(1), **settings)[0])
    return x * 10 ** ((makeup - now) / 20)[:, None]


def soft_clip(x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    return np.sign(x) * np.where(a <= KNEE, a, KNEE + ROOM * np.tanh((a - KNEE) / ROOM))


#: Settings of a recording: filters in Hz, percent and dB, volume in dB, compressor in dB and seconds; what is null is the chain's own.
SETTINGS = "high_pass double, hum_hz double, de_esser double, low double, mid double, high double, volume_db double, threshold double, ratio double, attack double, release double"
_FILTERS = ("high_pass", "hum_hz", "de_esser", "low", "mid", "high")


def _neighbours(mixed: DataFrame) -> DataFrame:
    """Segments with ``before`` and ``after``: the end of the one before, and the start of the one after them.

    A segment hands its ends to its neighbours in one exchange by recording and segment, so a recording is as many
    tasks as it has segments.
    """
    reach = (F.col("sample_rate") * WARM_SECONDS + F.ceil(F.col("sample_rate") / STEPS_A_SECOND)) * F.col("channels")
    own, seg = F.col("samples"), F.col("seg")
    tail = F.slice(own, F.greatest(F.lit(1), F.size(own) - reach + 1).cast("int"), reach.cast("int"))
    head = F.slice(own, 1, (F.ceil(F.col("sample_rate") / STEPS_A_SECOND) * F.col("channels")).cast("int"))
    part = lambda at, role, x: F.struct(at.cast("int").alias("seg"), F.lit(role).alias("role"), x.alias("x"))
    rest = [c for c in mixed.columns if c not in ("path", "seg", "samples")]
    rows = mixed.select("path", *rest, F.explode(F.array(part(seg, 0, own), part(seg + 1, 1, tail), part(seg - 1, 2, head))).alias("p"))
    of = lambda role, x: F.first(F.when(F.col("p.role") == role, x), ignorenulls=True)
    held = rows.groupBy("path", F.col("p.seg").alias("seg")).agg(of(0, F.struct(*rest)).alias("rest"), *(of(k, F.col("p.x")).alias(n) for k, n in enumerate(("samples", "before", "after"))))
    return held.where("samples IS NOT NULL").select("path", "seg", "rest.*", "samples", "before", "after")


def master(mixed: DataFrame, volume_db: float = 0.0, compress: bool = True, **settings: float) -> DataFrame:
    """The mix (path, sample_rate, channels, seg, samples) after filters, compressor, volume, limiter and soft clipping.

    settings: high_pass and hum_hz in Hz, de_esser in percent, low, mid and high in dB, for all recordings; a column
    ``settings`` (SETTINGS) holds each recording's own, which come first where they aren't null.
    """
    fixed = {**dict.fromkeys(_FILTERS, 0.0), "volume_db": volume_db, **COMPRESSOR, **settings}
    names = [c.split()[0] for c in SETTINGS.split(", ")]
    if "settings" in mixed.columns:
        have = mixed.schema["settings"].dataType.names
        own = F.struct(*((F.coalesce(F.col(f"settings.{n}").cast("double"), F.lit(float(fixed[n]))) if n in have else F.lit(float(fixed[n]))).alias(n) for n in names))
    else:
        own = F.struct(*(F.lit(float(fixed[n])).alias(n) for n in names))

    def run(batches):
        for part in batches:
            for r in part.itertuples():
                rate, shape, s = r.sample_rate, (-1, r.channels), r.settings
                block = lambda v: np.asarray(v if v is not None else [], float).reshape(shape)  # noqa: B023, E731
                before, x, after = block(r.before), block(r.samples), block(r.after)
                at = r.seg * SEGMENT_FRAMES * HOP - len(before)
                before = before[-at % max(1, rate // STEPS_A_SECOND) :] if at > 0 else before  # steps lie alike in every segment
                y = filtered(np.concatenate((before, x, after)), filters(rate, *(s[k] for k in _FILTERS)), rate * WARM_SECONDS)
                y = compressed(y, rate, {**COMPRESSOR, **{k: s[k] for k in ("threshold", "ratio", "attack", "release")}}) if compress else y
                y = soft_clip(compressed(y * 10 ** (s["volume_db"] / 20), rate, LIMITER))
                yield pd.DataFrame({"path": [r.path], "sample_rate": [rate], "channels": [r.channels], "seg": [r.seg], "samples": [y[len(before) : len(before) + len(x)].astype(np.float32).ravel()]})

    rows = _neighbours(mixed.select("path", "sample_rate", "channels", "seg", "samples", own.alias("settings")))
    return rows.mapInPandas(run, "path string, sample_rate int, channels int, seg int, samples array<float>")
