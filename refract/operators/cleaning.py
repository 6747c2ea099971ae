"""Automatic cleaning: what a recording needs is measured, turned into its own settings, and applied, in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import gain
from ..sources.audio import segments, slow_windows
from . import audio, chain, mixer

# The settings of a clean, where nothing was measured, and those that are always the same.
UNKNOWN = {"noise_reduction": 40.0, "high_pass": 40, "de_esser": 15, "de_reverb": 10, "volume": 0.0}
VOICE_BOOST, BACKGROUND, MUSIC_DB, HUM_DB, MID_DB = 20.0, 100.0, -6.0, -30.0, 1.0
COMPRESSOR = {"threshold": -22.0, "ratio": 2.0, "attack": 0.015, "release": 0.25}


def de_reverb_db(percent: Column) -> Column:
    return F.when(percent >= 95, -60.0).otherwise(-0.42 * percent)


def recommended(measured: DataFrame) -> DataFrame:
    """path, gains (array in the order of STEMS) and settings (chain.SETTINGS) of recordings (path, snr_db, rumble_db,
    sibilance_db, speech_db, hum_hz); what wasn't measured is null and gets a gentle clean."""
    c = F.col
    rec = mixer.recommend(c("snr_db"), c("rumble_db"), c("sibilance_db"), c("speech_db"))
    r = measured.select("path", F.coalesce("hum_hz", F.lit(0)).alias("hum_hz"), *(F.when(c("snr_db").isNull(), UNKNOWN[k]).otherwise(v).cast("double").alias(k) for k, v in rec.items()))
    db = mixer.macro_db(c("noise_reduction"), F.lit(VOICE_BOOST), F.lit(BACKGROUND))
    db |= {"music": F.lit(MUSIC_DB), "reverb": de_reverb_db(c("de_reverb")), "hum": F.when(c("hum_hz") > 0, HUM_DB).otherwise(db["hum"])}
    same = {"low": F.lit(0.0), "mid": F.lit(MID_DB), "high": F.lit(0.0), **{k: F.lit(v) for k, v in COMPRESSOR.items()}}
    own = {"high_pass": c("high_pass"), "hum_hz": c("hum_hz"), "de_esser": c("de_esser"), "volume_db": c("volume")}
    settings = F.struct(*((own | same)[n.split()[0]].cast("double").alias(n.split()[0]) for n in chain.SETTINGS.split(", ")))
    return r.select("path", F.array(*(gain(db.get(s, F.lit(0.0))).cast("double") for s in mixer.STEMS)).alias("gains"), settings.alias("settings"))


def measured(files: DataFrame, window_seconds: float = 4) -> DataFrame:
    """path and what analysis and mains tones say of every recording among files (path, content)."""
    return audio.analyse(segments(files)).join(audio.hum(slow_windows(files, window_seconds)), "path", "full")


def automatic(files: DataFrame, window_seconds: float = 4) -> DataFrame:
    """path, sample_rate, channels, seg, samples of recordings cleaned with the settings that each of them needs.

    Noise floors, settings and gains are one row a recording; segments meet them once and stay independent tasks.
    Recordings that can't be measured (under a second) get the gentle clean; those under one frame have nothing to
    separate and no rows, like files that aren't PCM.
    """
    cut = segments(files)
    own = recommended(audio.noise_floor(cut).select("path").join(measured(files, window_seconds), "path", "left"))
    return chain.master(audio.mix(cut, audio.noise_floor(cut).join(own, "path")))


def automatic_wav(files: DataFrame, window_seconds: float = 4) -> DataFrame:
    """path, seg, content: the cleaned recordings as WAV segments, their peaks guarded."""
    return audio.to_wav(automatic(files, window_seconds))
