"""Plain words for levels, layers, streams and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import half_up

# Badges and names that reports show.
CHANNELS = {1: "Single Audio Source", 2: "Left & Right Ear Experience", 6: "Home Cinema Surround"}
AUDIO_CODECS = {"aac": "Modern High-Efficiency", "mp3": "Universal Standard", "flac": "Lossless Compressed", "opus": "Ultra Low-Latency Voice"}
VIDEO_CODECS = {"h264": "Universal Video Standard", "avc1": "Universal Video Standard", "hevc": "High-Efficiency 4K", "h265": "High-Efficiency 4K", "vp9": "Modern Web Video", "av1": "Next-Generation Codec", "mjpeg": "Frame Image Sequence"}
FORMATS = {
    "mp4": "MP4 Video Container", "m4a": "M4A Audio Container", "wav": "WAV Studio Audio", "mp3": "MP3 Audio", "mov": "Apple QuickTime Movie", "png": "PNG Graphic Image", "jpg": "JPEG Photograph",
    "jpeg": "JPEG Photograph", "pdf": "Adobe PDF Document",
}
BOX_ROLES = (
    ("ftyp", "Identity Badge"), ("mvhd", "Movie Master Header"), ("moov", "Timeline & Index"), ("trak", "Media Track"), ("mdat", "Raw Media Payload"), ("fmt", "Audio Format Spec"), ("data", "Raw Audio Payload"),
    ("bext", "Studio Broadcast Header"), ("id3", "ID3 Tag Container"), ("ihdr", "Image Header"), ("idat", "Compressed Image Payload"),
)
ACOUSTIC = ((65, "Sub-bass / Hum"), (220, "Traffic / Engine Rumble"), (3500, "Vocal Formants / Speech"), (7000, "Presence / Fan Whine"))
SILENT_DB = -40.0


def _named(names: dict, key: Column, rest: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), key), F.lit(rest))


def channels(n: Column) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) == 0, "Unknown").otherwise(_named(CHANNELS, n.cast("int"), "Surround Sound"))


def depth(bits: Column, floating: Column) -> Column:
    return F.when(floating, "Studio Distortion-Free Math").when(bits >= 24, "High Dynamic Range (Studio Pro)").otherwise("Standard CD Precision")


def audio_codec(codec: Column) -> Column:
    return F.when(F.lower(codec).contains("pcm"), "100% Lossless Master").otherwise(_named(AUDIO_CODECS, F.lower(codec), "Audio Codec"))


def video_codec(codec: Column) -> Column:
    return _named(VIDEO_CODECS, F.lower(codec), "Video Codec")


def format_name(path: Column, otherwise: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv)), F.lower(F.substring_index(path, ".", -1))), otherwise, F.lit("Media File"))


def box_role(box: Column) -> Column:
    """The role of the first known word in a box's name."""
    out = F
    for word, role in BOX_ROLES:
        out = out.when(F.lower(box).contains(word), role)
    return out.otherwise("Structural Container Box")


def acoustic(hz: Column) -> Column:
    out = F
    for top, name in ACOUSTIC:
        out = out.when(hz <= top, name)
    return out.otherwise("Hiss / Air")


def pitch_at(height: Column, nyquist: Column) -> Column:
    """Hz at a height (0 to 1) of a spectrogram whose axis is bent by a power of 1.8."""
    return F.floor(F.pow(height, F.lit(1.8)) * nyquist)


def decibels(gain: Column) -> Column:
    """dB of a gain to one place; silence is -40."""
    return F.when(gain <= 0, SILENT_DB).otherwise(half_up(200 * F.log10(gain)) / 10)


def layer_status(stem: Column, gain: Column, mute: Column, solo: Column) -> Column:
    """What is done to a layer, in words."""
    db = decibels(gain)
    text = F.concat(F.when(db > 0, "+").otherwise(""), F.format_string("%.1f dB", db))
    cut = F.least(F.lit(99), half_up((1 - gain) * 100)).cast("string")
    return (
        F.when(mute, "MUTED (OFF)").when(solo, F.concat(F.lit("SOLO ("), text, F.lit(")"))).when((stem == "bg_voice") & (db >= -1), F.concat(F.format_string("%.1f dB", db), F.lit(" (100% PRESERVED)")))
        .when(db > 0.5, F.concat(text, F.lit(" (BOOSTED)"))).when(db <= -6, F.concat(text, F.lit(" (-"), cut, F.lit("%)"))).otherwise(text)
    )


def noise_cut(traffic: Column, fan: Column, hum: Column, voice: Column) -> dict[str, Column]:
    """Mean gain of the noise layers, its dB and percent removed, and how far the voice stands above it."""
    mean = (traffic + fan + hum) / 3
    return {"mean": mean, "db": decibels(mean), "percent": F.greatest(F.lit(0), F.least(F.lit(99), half_up((1 - mean) * 100).cast("int"))), "contrast": F.greatest(F.lit(0.0), half_up((decibels(voice) - decibels(mean)) * 10) / 10)}


def clock_ms(seconds: Column) -> Column:
    """``mm:ss.mmm``."""
    return F.format_string("%02d:%02d.%03d", F.floor(seconds / 60), F.floor(seconds % 60), F.floor((seconds % 1) * 1000))
