"""Gains of the nine layers: presets, macros, mutes and solos, recommended settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import gain, half_up

# Layers in order, and gains in dB of each preset (0 where not named).
STEMS = ("main_voice", "bg_voice", "traffic", "wind", "fan_ac", "hum", "music", "noise", "reverb")
PRESETS = {
    "cafe_preserve_voices": {"main_voice": 2.0, "bg_voice": 0.0, "traffic": -35.0, "fan_ac": -32.0, "hum": -40.0, "wind": -30.0, "noise": -24.0, "music": -12.0, "reverb": -6.0},
    "voice_only": {"main_voice": 3.0, "bg_voice": -30.0, "traffic": -40.0, "wind": -40.0, "fan_ac": -40.0, "hum": -40.0, "noise": -35.0, "music": -35.0, "reverb": -15.0},
    "remove_traffic_wind": {"traffic": -40.0, "wind": -40.0},
    "remove_fan_hum": {"fan_ac": -40.0, "hum": -40.0, "noise": -20.0},
    "dry_voice": {"main_voice": 1.0, "reverb": -40.0},
    "reset_unity": {},
}


def presets(spark) -> DataFrame:
    """preset, stem, db, gain: 54 rows."""
    rows = [(p, i, s, float(g.get(s, 0.0))) for p, g in PRESETS.items() for i, s in enumerate(STEMS)]
    return spark.createDataFrame(rows, "preset string, ordinal int, stem string, db double").withColumn("gain", gain(F.col("db")))


def macro_db(nr: Column, vb: Column, bg: Column) -> dict[str, Column]:
    """dB of each layer that the three sliders (percent) set; hum and noise layers follow noise reduction."""
    x = nr / 100
    cut = F.when(x >= 0.95, -60.0).otherwise(-45.0 * F.pow(x, F.lit(1.2)))
    return {
        "traffic": cut, "wind": cut, "fan_ac": cut, "noise": cut,
        "hum": F.when(cut <= -39.9, -60.0).otherwise(cut * 1.2),
        "main_voice": vb / 100 * 6,
        "bg_voice": (1 - bg / 100) * F.least(F.lit(0.0), cut * 0.8),
    }


def effective(rows: DataFrame, mix: str) -> DataFrame:
    """Gain after mutes and solos: a mute wins, a solo silences the layers without one."""
    solo = F.bool_or("solo").over(Window.partitionBy(mix))
    return rows.withColumn("gain", F.when(F.col("mute") | (solo & ~F.col("solo")), 0.0).otherwise(F.col("value")))


def recommend(snr: Column, rumble: Column, sibilance: Column, speech: Column) -> dict[str, Column]:
    """Settings from the analysis of a recording."""
    clamp = lambda v, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), v))
    return {
        "noise_reduction": clamp(half_up(55 - (snr - 5) * 0.9).cast("double"), 25.0, 55.0),
        "high_pass": F.when(rumble > -8, 80).otherwise(40),
        "de_esser": F.when(sibilance > -12, 30).when(sibilance > -16, 20).otherwise(10),
        "de_reverb": F.when(snr < 20, 15).otherwise(10),
        "volume": clamp(half_up((-20 - speech) * 2) / 2, 0.0, 9.0),
    }
