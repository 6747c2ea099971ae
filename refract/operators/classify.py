"""Origin and editing verdicts over one row a file with its tags as columns or a map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in software names, in order of preference.
EDITORS = ("photoshop", "gimp", "lightroom", "canva", "premiere", "after effects", "audacity", "final cut", "topaz", "inpaint", "pixlr", "procreate", "davinci")
ENCODERS = ("lavf", "ffmpeg", "handbrake", "vlc", "format factory", "obs-studio", "coreaudio")

# Fixed values: (words, device, maker, hardware) by software signature, in order of preference.
SIGNATURES = [
    (("coreaudio", "core media"), "Apple device or Mac (Core Media)", "Apple Inc.", "Apple media software"),
    (("mediacodec", "android"), "Android System (MediaCodec Hardware Engine)", "Google / Android", "Android Hardware Subsystem"),
    (("audacity",), "Audacity Digital Audio Workstation (DAW)", "Audacity Team", "Digital Audio Workstation (DAW)"),
    (("lame",), "LAME MP3 Audio Workstation", "LAME Engine", "Audio Encoding Engine"),
    (("lavf", "ffmpeg"), "No Hardware Device Tagged (Software Stream Export)", "FFmpeg / Libavformat (Software)", "Software Media Muxer"),
]
UNTAGGED = ("Device Not Tagged (Common for WhatsApp / Forwarded Files)", "Unknown / Stripped", "Untagged Media Asset")


def first_word(text: Column, words: tuple[str, ...]) -> Column:
    """The first of the words that the lower-cased text contains, null if none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*(F.when(low.contains(w), F.lit(w)) for w in words))


def device(make: Column, model: Column, originator: Column, software: Column) -> Column:
    """struct(device, maker, hardware, rule): camera tags, then broadcast-wave originator, then software."""
    soft = F.lower(F.coalesce(software, F.lit("")))
    camera = make.isNotNull() | model.isNotNull()
    m, k = F.coalesce(make, F.lit("")), F.coalesce(model, F.lit(""))
    name = F.when(F.lower(k).startswith(F.lower(m)), k).otherwise(F.trim(F.concat_ws(" ", m, k)))
    row = lambda a, b, c, d: F.struct(a.alias("device"), b.alias("maker"), c.alias("hardware"), F.lit(d).alias("rule"))
    text = lambda t, d: row(*(F.lit(x) for x in t), d)
    out = F.when(camera, row(name, make, F.lit("Physical Hardware Device"), "camera"))
    out = out.when(originator.isNotNull(), row(originator, F.substring_index(originator, " ", 1), F.lit("Studio Audio Hardware Recorder"), "recorder"))
    for words, *found in SIGNATURES:
        hit = soft.contains(words[0])
        for w in words[1:]:
            hit |= soft.contains(w)
        out = out.when(hit, text(found, "software"))
    return out.otherwise(text(UNTAGGED, "untagged"))


def elapsed(created: Column, modified: Column) -> Column:
    """Seconds from created to modified (``Y:M:D`` dates too); null where either can't be read."""
    stamp = lambda c: F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(c, r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3")))
    return stamp(modified) - stamp(created)


def elapsed_text(seconds: Column) -> Column:
    """``3 days, 4 hours later`` and so on, null up to a minute."""
    s = seconds
    days, hours, minutes = F.floor(s / 86400), F.floor((s % 86400) / 3600), F.floor((s % 3600) / 60)
    text = lambda *x: F.concat(*(v.cast("string") if isinstance(v, Column) else F.lit(v) for v in x))
    return F.when(s > 60, F.when(days > 0, text(days, " days, ", hours, " hours later")).when(hours > 0, text(hours, " hours, ", minutes, " minutes later")).otherwise(text(minutes, " minutes later")))


def tampering(is_document: Column, is_ai: Column, software: Column, created: Column, modified: Column, events: Column, bare: Column) -> Column:
    """Verdict in order: AI marks, edited, saved later (documents), re-encoded, stripped, else original.

    events: entries of the audit trail.  bare: a large picture or film without tags.
    """
    altered = F.coalesce(elapsed(created, modified) > 60, F.lit(False))
    editor, encoder = first_word(software, EDITORS).isNotNull(), first_word(software, ENCODERS).isNotNull()
    return (
        F.when(is_ai, "AI_GENERATED").when(~is_document & (editor | (altered & (events > 1))), "TAMPERED").when(is_document & altered, "EDITED_LATER")
        .when(encoder | altered, "RE_ENCODED").when(bare, "METADATA_STRIPPED").otherwise("AUTHENTIC_ORIGINAL")
    )
