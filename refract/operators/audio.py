"""Noise statistics, nine-layer masks, cleaning and analysis of recordings, segment by segment.

A segment carries the samples before it that warm up the mask smoothing and those after it that its last
frames cover, so its own samples come out whole and segments are never merged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.audio import HOP, SEGMENT_FRAMES, WINDOW, wav_bytes
from .mixer import STEMS
from .signal import HUM_HZ, HUM_WIDTH

HALF = WINDOW // 2
HANN = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)).astype(np.float32)
# Histogram of log magnitudes, and the share of frames below the noise floor.
LOG_LEAST, PER_DECADE, BINS, NOISE_SHARE = -6, 12, 120, 0.15
#: Frames of a recording that the noise statistics take, evenly spaced.
NOISE_FRAMES = 4000
ATTACK, DECAY = 0.85, 0.42


def _spectra(samples, channels: int) -> np.ndarray:
    """Spectra (channels, frames, HALF + 1) of interleaved samples."""
    x = np.asarray(samples, np.float32).reshape(-1, channels).T
    if x.shape[1] < WINDOW:
        return np.zeros((channels, 0, HALF + 1), np.complex64)
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW, axis=1)[:, ::HOP]
    return np.fft.rfft(frames * HANN, axis=2).astype(np.complex64)


def _middle(spectra: np.ndarray) -> np.ndarray:
    return np.abs(spectra[:2].mean(axis=0))[:, :HALF]


def noise_floor(segments: DataFrame) -> DataFrame:
    """path, floor: the noise magnitude of each frequency, from histograms that tasks count and Spark sums."""

    def count(batches):
        for part in batches:
            for r in part.itertuples():
                total = max(0, (r.n_samples - WINDOW) // HOP + 1)
                stride = max(1, total // NOISE_FRAMES)
                m = _middle(_spectra(r.samples, r.channels))
                frame = np.arange(len(m)) + r.start // HOP
                own = (frame >= r.seg * SEGMENT_FRAMES) & (frame < (r.seg + 1) * SEGMENT_FRAMES) & (frame % stride == 0)
                b = np.clip(np.floor((np.log10(m[own] + 1e-12) - LOG_LEAST) * PER_DECADE), 0, BINS - 1).astype(np.int64)
                cells, n = np.unique(b + np.arange(HALF) * BINS, return_counts=True)
                yield pd.DataFrame({"path": r.path, "cell": cells.astype(np.int32), "n": n})

    cells = segments.mapInPandas(count, "path string, cell int, n bigint").groupBy("path", "cell").agg(F.sum("n").alias("n"))
    counts = cells.groupBy("path").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))  # at most HALF * BINS

    @F.pandas_udf("array<float>")
    def level(values: pd.Series) -> pd.Series:
        def one(cells):
            h = np.zeros(HALF * BINS, np.int64)
            h[[c["cell"] for c in cells]] = [c["n"] for c in cells]
            c = np.cumsum(h.reshape(HALF, BINS), axis=1)
            at = (c >= max(1, int(NOISE_SHARE * c[0, -1]))).argmax(axis=1)
            return (10.0 ** (LOG_LEAST + (at + 0.5) / PER_DECADE)).astype(np.float32)

        return values.map(one)

    return counts.select("path", level("cells").alias("floor"))


# Frequency bands (Hz) and weights of the layers.
def masks(m: np.ndarray, floor: np.ndarray, rate: int) -> np.ndarray:
    """Shares (frames, layers, bins) of the nine layers for magnitudes (frames, bins); each bin's shares sum to 1."""
    hz = np.arange(HALF) * rate / WINDOW
    speech = (np.arange(HALF) >= np.ceil(300 * WINDOW / rate)) & (np.arange(HALF) <= np.floor(3400 * WINDOW / rate))
    total = m.sum(axis=1)
    vocal = np.divide(m[:, speech].sum(axis=1), total, out=np.zeros_like(total), where=total > 0)[:, None]
    base = np.where(floor > 0, floor, 1e-5)
    snr = m / (base + 1e-6)
    voiced = (vocal > 0.40) & (snr > 2.2)
    out = {s: np.zeros_like(m) for s in STEMS}
    hum = (np.abs(hz[:, None] - np.array(HUM_HZ)) <= HUM_WIDTH).any(axis=1) & (snr > 1.8)
    out["hum"] = np.where(hum, 0.88, 0.0)
    slope = np.minimum(1, (220 - hz) / 180) * np.where(voiced, 0.25, 0.78)
    out["traffic"] = np.where(hz < 35, 0.92, np.where((hz <= 220) & ~hum, slope, 0.0))
    out["wind"] = np.where((hz >= 30) & (hz <= 380), 0.28 * (1 - np.minimum(1, snr / 10)), 0.0)
    steady = np.minimum(1, base / (m + 1e-6))
    out["fan_ac"] = np.where((hz >= 200) & (hz <= 5500), steady * 0.70, 0.0)
    out["noise"] = np.where(hz > 4000, steady * 0.75, 0.0)
    peak = np.zeros(m.shape, bool)
    peak[:, 2:-1] = (m[:, 2:-1] > m[:, 1:-2]) & (m[:, 2:-1] > m[:, 3:])
    body = (hz >= 280) & (hz <= 3800)
    edge = voiced & ~body & (hz >= 85) & (hz <= 10000)
    far = body & ~voiced & ((vocal > 0.20) | ((snr > 1.15) & (snr <= 2.2)))
    near = body & voiced
    out["main_voice"] = np.select([near & peak, near, far, edge], [0.90, 0.78, 0.16, 0.70], 0.0)
    out["bg_voice"] = np.select([near & peak, near, far, edge], [0.06, 0.14, 0.74, 0.05], 0.0)
    out["music"] = np.where((hz >= 500) & (hz <= 8000) & (snr > 3) & (vocal < 0.35), 0.65, 0.0)
    out["reverb"] = np.where((hz >= 300) & (hz <= 4500) & (vocal < 0.28) & (snr > 1.05) & (snr < 1.9), 0.38, 0.0)
    share = np.stack([out[s] for s in STEMS], axis=1)
    whole = share.sum(axis=1, keepdims=True)
    only_noise = (np.array(STEMS) == "noise").astype(float)[None, :, None]
    share = np.where(whole > 0, share / np.where(whole > 0, whole, 1), only_noise)
    state = np.zeros(share.shape[1:])
    for f in range(len(share)):  # a recurrence over frames, whole spectra at a time
        state = state + np.where(share[f] > state, ATTACK, DECAY) * (share[f] - state)
        n = state.sum(axis=0)
        share[f] = np.divide(state, n, out=state.copy(), where=n > 0)
    return share


def _own(r) -> tuple[int, int]:
    """The samples that a segment owns."""
    lo = r.seg * SEGMENT_FRAMES * HOP
    return lo, min(r.n_samples, lo + SEGMENT_FRAMES * HOP)


def _resynthesise(spectra: np.ndarray, weight: np.ndarray, r) -> np.ndarray:
    """Own samples (n, channels) of masked spectra, added up and divided by the sum of squared windows."""
    w = np.concatenate((weight, weight[:, -1:]), axis=1)
    frames = np.fft.irfft(spectra * w, axis=2) * HANN
    lo, hi = _own(r)
    out = np.zeros((len(spectra), max(hi - r.start, r.start + spectra.shape[1] * HOP + WINDOW - r.start)))
    norm = np.zeros(out.shape[1])
    for f in range(spectra.shape[1]):
        out[:, f * HOP : f * HOP + WINDOW] += frames[:, f]
        norm[f * HOP : f * HOP + WINDOW] += HANN * HANN
    out = out / np.where(norm > 1e-4, norm, 1)
    return out[:, lo - r.start : hi - r.start].T.astype(np.float32)


MIXED = "path string, sample_rate int, channels int, seg int, samples array<float>"


def mix(segments: DataFrame, floors: DataFrame, gains: dict[str, float] | None = None) -> DataFrame:
    """path, sample_rate, channels, seg, samples (interleaved) of the recording with a gain on each layer.

    gains: of all recordings by layer (1 where not named); without them each recording has its own in the array
    ``gains`` of floors, in the order of STEMS.  A struct ``settings`` of floors comes along for the chain.
    """
    if gains is not None:
        floors = floors.withColumn("gains", F.array(*(F.lit(float(gains.get(s, 1.0))) for s in STEMS)))
    more = [c for c in ("settings",) if c in floors.columns]
    kinds = MIXED + "".join(f", {c} {floors.schema[c].dataType.simpleString()}" for c in more)

    def run(batches):
        for part in batches:
            for r in part.itertuples():
                s = _spectra(r.samples, r.channels)
                weight = np.einsum("s,fsk->fk", np.asarray(r.gains), masks(_middle(s), np.asarray(r.floor), r.sample_rate))
                row = {"path": [r.path], "sample_rate": [r.sample_rate], "channels": [r.channels], "seg": [r.seg], "samples": [_resynthesise(s, weight, r).ravel()]}
                yield pd.DataFrame(row | {c: [getattr(r, c)] for c in more})

    return segments.join(floors.select("path", "floor", "gains", *more), "path").mapInPandas(run, kinds)


def layers(segments: DataFrame, floors: DataFrame) -> DataFrame:
    """path, sample_rate, channels, seg, n_segs, layers: the own samples (interleaved) of all nine layers, in the order of STEMS.

    A segment is transformed and its masks are made once; the layers add up to the recording.
    """

    def run(batches):
        for part in batches:
            for r in part.itertuples():
                s = _spectra(r.samples, r.channels)
                share = masks(_middle(s), np.asarray(r.floor), r.sample_rate)
                made = [_resynthesise(s, share[:, k], r).ravel() for k in range(len(STEMS))]
                n = max(1, -(-r.n_samples // (SEGMENT_FRAMES * HOP)))
                yield pd.DataFrame({"path": [r.path], "sample_rate": [r.sample_rate], "channels": [r.channels], "seg": [r.seg], "n_segs": [n], "layers": [made]})

    return segments.join(floors.select("path", "floor"), "path").mapInPandas(run, "path string, sample_rate int, channels int, seg int, n_segs int, layers array<array<float>>")


def stem_energy(segments: DataFrame, floors: DataFrame) -> DataFrame:
    """path, stem, share (percent) of the energy of each layer."""

    def run(batches):
        for part in batches:
            for r in part.itertuples():
                m = _middle(_spectra(r.samples, r.channels))
                share = masks(m, np.asarray(r.floor), r.sample_rate)
                own = np.arange(len(m)) + r.start // HOP >= r.seg * SEGMENT_FRAMES
                yield pd.DataFrame({"path": r.path, "stem": STEMS, "energy": np.einsum("fk,fsk->s", m[own], share[own])})

    e = segments.join(floors, "path").mapInPandas(run, "path string, stem string, energy double").groupBy("path", "stem").agg(F.sum("energy").alias("energy"))
    whole = e.groupBy("path").agg(F.sum("energy").alias("whole"))
    return e.join(whole, "path").select("path", "stem", (100 * F.try_divide("energy", "whole")).alias("share"))


ANALYSIS = "path string, frames int, noise_db double, speech_db double, snr_db double, sibilance_db double, rumble_db double"


def analyse(segments: DataFrame, most: int = 600) -> DataFrame:
    """Noise, speech level, SNR, sibilance and rumble of each recording from up to 600 evenly spaced frames.

    Frames are measured where the segments lie; a recording's few hundred rows are summed up by groups.
    """

    def measure(batches):
        for part in batches:
            for r in part.itertuples():
                frames = min(most, (r.n_samples - WINDOW) // WINDOW)
                if frames < 20 or r.n_samples < r.sample_rate:
                    continue
                x = np.asarray(r.samples, np.float32).reshape(-1, r.channels)[:, :2].mean(axis=1)
                at = np.arange(frames) * (r.n_samples - WINDOW) // max(1, frames - 1)
                lo, hi = _own(r)
                at = at[(at >= lo) & (at < hi)] - r.start
                at = at[at + WINDOW <= len(x)]
                if not len(at):
                    continue
                v = x[at[:, None] + np.arange(WINDOW)]
                power = np.abs(np.fft.rfft(v * HANN, axis=1)) ** 2
                bin_ = lambda hz: max(1, min(HALF - 1, int(hz * WINDOW / r.sample_rate + 0.5)))  # noqa: B023, E731
                band = lambda a, b: power[:, bin_(a) : bin_(b) + 1].sum(axis=1)  # noqa: B023, E731
                yield pd.DataFrame({"path": r.path, "db": 10 * np.log10((v * v).mean(axis=1) + 1e-12), "low": power[:, 1 : bin_(80)].sum(axis=1), "speech": band(300, 3400), "sib": band(5000, 9000)})

    f = segments.mapInPandas(measure, "path string, db double, low double, speech double, sib double")
    g = f.groupBy("path").agg(F.sort_array(F.collect_list("db")).alias("s"), F.sum("low").alias("low"), F.sum("speech").alias("speech"))
    at = lambda p: F.get("s", F.least(F.size("s") - 1, F.floor(F.lit(p) * F.size("s")).cast("int")))
    g = g.withColumn("loud", at(0.7))
    loud = f.join(g.select("path", "loud"), "path").where("db >= loud").groupBy("path").agg(F.sum("sib").alias("sib"), F.sum("speech").alias("loud_speech"))
    ratio = lambda a, b: 10 * F.log10((F.col(a) + 1e-20) / (F.col(b) + 1e-20))
    return g.join(loud, "path").select(
        "path", F.size("s").alias("frames"), at(0.1).alias("noise_db"), at(0.9).alias("speech_db"), F.greatest(F.lit(0.0), at(0.9) - at(0.1)).alias("snr_db"),
        ratio("sib", "loud_speech").alias("sibilance_db"), ratio("low", "speech").alias("rumble_db"),
    )


#: Rows of a spectrogram and the exponent that bends them towards low frequencies; decibels that a frame is kept above.
SPECTRUM_ROWS, BEND, LEAST_DB = 256, 1.8, -120.0


def spectrogram(segments: DataFrame, columns: int = 1000, rows: int = SPECTRUM_ROWS) -> DataFrame:
    """path, col, row, db: the loudest of each cell of time and bent frequency, in decibels of the magnitude.

    A recording's frames are dealt to at most ``columns`` columns of whole frames; row r starts at the bin
    (r / rows) ** BEND of all.  Cells are maxima, so what segments tell of a column they share is merged by maximum.
    """
    edge = np.unique((HALF * (np.arange(rows) / rows) ** BEND).astype(int), return_index=True)

    def run(batches):
        for part in batches:
            for r in part.itertuples():
                m = _middle(_spectra(r.samples, r.channels))
                frame = np.arange(len(m)) + r.start // HOP
                own = (frame >= r.seg * SEGMENT_FRAMES) & (frame < (r.seg + 1) * SEGMENT_FRAMES)
                if not own.any():
                    continue
                total = max(1, (r.n_samples - WINDOW) // HOP + 1)
                col = frame[own] // max(1, -(-total // columns))
                first = np.flatnonzero(np.diff(col, prepend=-1))
                cells = np.maximum.reduceat(np.maximum.reduceat(m[own], edge[0], axis=1), first, axis=0)
                db = np.maximum(LEAST_DB, 20 * np.log10(cells + 1e-12))
                yield pd.DataFrame({"path": r.path, "col": np.repeat(col[first], len(edge[0])), "row": np.tile(edge[1], len(first)), "db": db.ravel()})

    found = segments.mapInPandas(run, "path string, col int, row int, db double")
    return found.groupBy("path", "col", "row").agg(F.max("db").alias("db"))


#: Zero crossings of the resampling filter on each side, its Kaiser window's shape, and the share of the band that passes.
CROSSINGS, SHAPE, PASS = 48, 12.0, 0.92
#: Outputs whose filters are made together.
OUTPUTS = 1 << 14


def resampled(x: np.ndarray, start: int, lo: int, hi: int, rate: int, to: int) -> np.ndarray:
    """Samples lo .. hi of the signal at the rate ``to``; x: input samples (n, channels) from ``start`` on, zeros beyond.

    Each output is a windowed sinc over the inputs around it; the filters of equal phases are made once.
    """
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    band = PASS * min(1.0, to / rate)
    reach = int(np.ceil(CROSSINGS / band))
    out = np.zeros((hi - lo, x.shape[1]))
    padded = np.concatenate((np.zeros((reach, x.shape[1])), x, np.zeros((reach + 1, x.shape[1]))))
    for a in range(lo, hi, OUTPUTS):
        n = np.arange(a, min(hi, a + OUTPUTS), dtype=np.int64)
        at, phase = n * down // up, n * down % up
        kinds, which = np.unique(phase, return_inverse=True)
        t = np.arange(-reach, reach + 1)[None, :] - kinds[:, None] / up
        taps = band * np.sinc(band * t) * np.i0(SHAPE * np.sqrt(np.maximum(0, 1 - (t / (reach + 1)) ** 2))) / np.i0(SHAPE)
        first = at - start
        inside = (first >= 0) & (first < len(x))
        frames = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1, axis=0)[np.where(inside, first, 0)]
        out[n - lo] = np.where(inside[:, None], np.einsum("nck,nk->nc", frames, taps[which]), 0)
    return out


def resample(segments: DataFrame, rate: int) -> DataFrame:
    """path, sample_rate, channels, seg, samples of recordings at another rate: MIXED, by the segments of the input.

    A segment owns the outputs whose moments lie in its own samples; its halo covers the filter at its edges, so pieces
    equal one run.  Recordings of that rate pass as they are.
    """

    def run(batches):
        for part in batches:
            for r in part.itertuples():
                lo, hi = _own(r)
                x = np.asarray(r.samples, np.float32).reshape(-1, r.channels)
                a, b = (-(-v * rate // r.sample_rate) for v in (lo, hi))
                y = x[lo - r.start : hi - r.start] if r.sample_rate == rate else resampled(x.astype(float), r.start, a, b, r.sample_rate, rate)
                yield pd.DataFrame({"path": [r.path], "sample_rate": [rate], "channels": [r.channels], "seg": [r.seg], "samples": [y.astype(np.float32).ravel()]})

    return segments.mapInPandas(run, MIXED)


# Mains frequencies, how many quiet windows are heard, and the least dB of a hum.
MAINS, QUIET, HUM_SCORE, HUM_FIRST = (50, 60), 6, 7.0, 5.0


def hum(windows: DataFrame) -> DataFrame:
    """path, hum_hz (0: none), hum_db: a steady mains tone in the quietest windows of a recording.

    A tone's prominence is its power against the mean of those 5 Hz below and above, the median over the
    windows (the upper one of two); the tone and two of its first three harmonics must stand out.
    """
    energy = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    rank = F.row_number().over(Window.partitionBy("path").orderBy("energy", "window"))
    quiet = windows.withColumn("energy", energy).withColumn("n", rank).where(F.col("n") <= QUIET)

    def listen(batches):
        for part in batches:
            rows = []
            for r in part.itertuples():
                n = len(r.x)
                x = np.asarray(r.x, float) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))
                power = lambda hz: abs(np.exp(-2j * np.pi * hz / r.rate * np.arange(n)) @ x) ** 2 + 1e-20  # noqa: B023, E731
                rows += [(r.path, f0, h, 10 * np.log10(power(f0 * h) / (0.5 * (power(f0 * h - 5) + power(f0 * h + 5))))) for f0 in MAINS for h in (1, 2, 3)]
            yield pd.DataFrame(rows, columns=["path", "f0", "h", "db"])

    heard = quiet.select("path", "rate", "x").mapInPandas(listen, "path string, f0 int, h int, db double")
    middle = heard.groupBy("path", "f0", "h").agg(F.sort_array(F.collect_list("db")).alias("s")).select("path", "f0", "h", F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("db"))
    score = middle.groupBy("path", "f0").agg(F.avg("db").alias("score"), F.max(F.when(F.col("h") == 1, F.col("db"))).alias("first"), F.count_if(F.col("db") >= HUM_FIRST).alias("strong"))
    found = (F.col("score") >= HUM_SCORE) & (F.col("first") >= HUM_FIRST) & (F.col("strong") >= 2)
    best = score.groupBy("path").agg(F.max_by(F.struct("f0", "score"), F.when(found, F.col("score"))).alias("b"), F.bool_or(found).alias("any"))
    return best.select("path", F.when(F.col("any"), F.col("b.f0")).otherwise(0).alias("hum_hz"), F.when(F.col("any"), F.col("b.score")).otherwise(0.0).alias("hum_db"))


def to_wav(mixed: DataFrame, bits: int = 16, top: float = 0.989) -> DataFrame:
    """path, seg, content: each segment as a WAV file, all scaled alike where the recording's peak is above ``top``."""
    peak = mixed.groupBy("path").agg(F.max(F.array_max(F.transform("samples", F.abs))).alias("peak"))

    def run(batches):
        for part in batches:
            rows = []
            for r in part.itertuples():
                x = np.asarray(r.samples, float).reshape(-1, r.channels)
                rows.append((r.path, r.seg, wav_bytes(x * (top / r.peak if r.peak > top else 1), r.sample_rate, bits)))
            yield pd.DataFrame(rows, columns=["path", "seg", "content"])

    return mixed.join(peak, "path").mapInPandas(run, "path string, seg int, content binary")
