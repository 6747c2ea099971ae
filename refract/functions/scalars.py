"""Scalar functions as column expressions: dates, places, sizes, clocks, decibels, quality bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAC_EPOCH = 2_082_844_800


def half_up(x: Column) -> Column:
    """Rounding with halves toward plus infinity."""
    return F.floor(x + 0.5)


def mac_time(seconds: Column) -> Column:
    """Timestamp of seconds since 1904."""
    return F.timestamp_seconds(seconds - MAC_EPOCH)


def pdf_date(text: Column) -> Column:
    """ISO-8601 of ``D:YYYYMMDDHHmmSSOHH'mm'``; text that isn't such a date stays as it is."""
    p = r"D?:?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?\s*(Z|[+-])?(\d{2})?'?(\d{2})?"
    part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(text, p, i), F.lit("")), F.lit(default))
    sign = F.regexp_extract(text, p, 7)
    zone = F.when(sign.isin("", "Z"), "Z").otherwise(F.concat(sign, part(8, "00"), F.lit(":"), part(9, "00")))
    iso = F.concat(F.regexp_extract(text, p, 1), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit("T"), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"), zone)
    return F.when(text.rlike(p), iso).otherwise(text)


ISO6709 = r"([+-]\d{1,3}(?:\.\d+)?)([+-]\d{1,3}(?:\.\d+)?)([+-]\d+(?:\.\d+)?)?"


def iso6709(text: Column) -> Column:
    """struct(lat, lon, alt) of ``+lat-lon+alt``, null outside the globe."""
    part = lambda i: F.nullif(F.regexp_extract(text, ISO6709, i), F.lit("")).cast("double")
    inside = (F.abs(part(1)) <= 90) & (F.abs(part(2)) <= 180)
    return F.when(inside, F.struct(part(1).alias("lat"), part(2).alias("lon"), part(3).alias("alt")))


def dms(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Decimal degrees; south and west are negative."""
    v = degrees + minutes / 60 + seconds / 3600
    return F.when(ref.isin("S", "W"), -v).otherwise(v)


def hemisphere(v: Column, pos: str, neg: str) -> Column:
    return F.when(v >= 0, pos).otherwise(neg)


def gain(db: Column) -> Column:
    """Linear gain of decibels; -39.9 and less is silence."""
    return F.when(db <= -39.9, 0.0).otherwise(F.pow(F.lit(10.0), db / 20))


def soft_clip(x: Column, knee: float = 0.7, room: float = 0.25) -> Column:
    a = F.abs(x)
    return F.signum(x) * F.when(a <= knee, a).otherwise(knee + room * F.tanh((a - knee) / room))


def parse_clock(text: Column) -> Column:
    """Seconds of ``h:m:s``, ``m:s`` or ``s``: a fold in base 60."""
    return F.aggregate(F.split(text, ":"), F.lit(0.0), lambda acc, x: acc * 60 + x.cast("double"))


def clock(seconds: Column) -> Column:
    """``h:mm:ss``, without hours below one."""
    s = F.floor(seconds).cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(r)))


def size_unit(n: Column) -> Column:
    return F.when(n < 1024, "B").when(n < 1024**2, "KB").when(n < 1024**3, "MB").otherwise("GB")


def size_value(n: Column) -> Column:
    """The number that goes with size_unit."""
    return F.when(n < 1024, n.cast("double")).when(n < 1024**2, n / 1024).when(n < 1024**3, n / 1024**2).otherwise(n / 1024**3)


def band(value: Column, steps: list[tuple[float, str]], rest: str, inclusive: bool = True) -> Column:
    """The label of the first lower bound that value reaches, highest bound first."""
    out = F
    for bound, label in steps:
        out = out.when(value >= bound if inclusive else value > bound, F.lit(label))
    return out.otherwise(F.lit(rest))


# Quality bands.
BITRATE = [(321, "High Bitrate / Studio Master"), (193, "High-Fidelity Audio"), (96, "Standard Streaming Quality"), (1, "Voice / Speech Clarity")]
SAMPLE_RATE = [(96000, "Ultra High-Res Studio Audio"), (48000, "Pro Video / Film Standard"), (44100, "CD Master Quality"), (22050, "Voice / Speech Clarity"), (1, "Standard Audio")]
RESOLUTION = [(3840, 2160, "4K Ultra HD"), (2560, 1440, "2K Quad HD"), (1920, 1080, "Full HD 1080p"), (1280, 720, "HD 720p")]
FRAME_RATE = [(60, "Super Smooth Motion (60 FPS)"), (29, "Standard Video Motion (30 FPS)"), (23, "Cinematic Movie Motion (24 FPS)")]


def resolution(w: Column, h: Column) -> Column:
    out = F
    for a, b, label in RESOLUTION:
        out = out.when((w >= a) | (h >= b), F.lit(label))
    return out.otherwise("Standard Definition (SD)")


def xml_text(xml: Column, tag: str) -> Column:
    """Text of the first such element: tags stripped, five entities decoded, trimmed; null if there is none."""
    p = f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>"
    t = F.regexp_replace(F.regexp_extract(xml, p, 1), "<[^>]+>", "")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.when(xml.rlike(p), F.trim(t))
