"""The report on a file: what it is, whether an AI made it, its credentials, origin and edits, composed from one row a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import half_up, size_unit, size_value
from ..sources.containers import boxes
from ..sources.walk import walk
from . import ai_origin, media, signatures

# Titles and states of the rows, the state of a verdict on credentials, extensions by kind.
TITLES = ("What it is", "Made by AI?", "Content Credentials", "Where it came from", "Has it been edited?")
CREDENTIAL_STATES = {"valid": "good", "valid_untrusted": "warn", "partial": "warn", "invalid": "bad", "unreadable": "warn"}
IMAGES = ("jpg", "jpeg", "png", "webp", "gif", "heic", "heif", "avif", "tif", "tiff", "bmp", "svg")
DOCUMENTS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "txt", "rtf", "zip")
SOUNDS = ("mp3", "wav", "wave", "m4a", "m4b", "aac", "flac", "ogg", "oga", "opus", "wma", "aif", "aiff", "aifc", "caf", "amr", "awb", "mka", "weba")
FILMS = ("mp4", "m4v", "mov", "webm", "mkv", "avi", "3gp", "mpg", "mpeg", "ogv", "wmv", "flv")


def cleaning_support(has_sound: Column, has_picture: Column, extension: Column, mime: Column) -> Column:
    """struct(available, unsure, can_try, reason): whether a file has sound that could be cleaned.

    unsure: its name says sound that wasn't found; can_try: nothing is known of it; reason (image, document, silent,
    unknown) where it isn't available.
    """
    e, m = F.lower(extension), F.coalesce(F.lower(mime), F.lit(""))
    told = lambda available, unsure, can_try, reason: F.struct(F.lit(available).alias("available"), F.lit(unsure).alias("unsure"), F.lit(can_try).alias("can_try"), F.lit(reason).alias("reason"))
    named = m.startswith("audio/") | e.isin(*SOUNDS)
    return (
        F.when(has_sound, told(True, False, False, None)).when(m.startswith("image/") | e.isin(*IMAGES), told(False, False, False, "image")).when(e.isin(*DOCUMENTS), told(False, False, False, "document"))
        .when(has_picture & named, told(True, True, False, None)).when(has_picture, told(False, False, False, "silent")).when(named | m.startswith("video/") | e.isin(*FILMS), told(True, True, False, None))
        .otherwise(told(False, False, True, "unknown"))
    )


def escaped(text: Column) -> Column:
    """Text for HTML: the five characters that mean something in it."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def size_text(size: Column) -> Column:
    """Bytes in the largest fitting unit, with two places where it isn't bytes."""
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(F.concat(F.format_string("%.2f", size_value(size.cast("double"))), F.lit(" "), size_unit(size)))


def length_text(seconds: Column) -> Column:
    s = half_up(seconds).cast("bigint")
    return F.when(s >= 60, F.format_string("%d min %d sec", F.floor(s / 60), s % 60)).otherwise(F.format_string("%d second", s))


def what(r: dict[str, Column]) -> Column:
    """An image of so many pixels, a film with or without sound, a recording, or a file; r: kind, width, height, seconds, has_sound."""
    pixels = F.when(r["width"].isNotNull(), F.format_string("%d × %d pixels", r["width"], r["height"])).otherwise("picture")
    length = length_text(r["seconds"])
    return (
        F.when(r["kind"] == "image", F.concat(F.lit("an image ("), pixels, F.lit(")"))).when((r["kind"] == "video") & r["has_sound"], F.concat(F.lit("a "), length, F.lit(" video with sound")))
        .when(r["kind"] == "video", F.concat(F.lit("a "), length, F.lit(" silent video"))).when(r["kind"] == "audio", F.concat(F.lit("a "), length, F.lit(" audio recording"))).otherwise("a file")
    )


def summary(rows: DataFrame) -> DataFrame:
    """path, place, title, state, text: the rows of the report of files.

    rows: path, kind, width, height, seconds, has_sound, size, ai (struct of ai_origin.judged), status and headline of
    the credentials, created, device, tampering (classify.tampering); what isn't known is null.
    """
    c = F.col
    row = lambda title, state, text: F.struct(F.lit(title).alias("title"), state.alias("state"), text.alias("text"))
    info = F.lit("info")
    first = F.concat(F.lit("This is "), what({k: c(k) for k in ("kind", "width", "height", "seconds", "has_sound")}), F.lit(" ("), size_text(c("size")), F.lit(")."))
    model = F.when(c("ai.model") != F.coalesce("ai.tool", F.lit("")), F.concat(F.lit('using the model "'), c("ai.model"), F.lit('"')))
    parts = F.concat_ws(", ", F.concat(F.lit("made with "), c("ai.tool")), model)
    sure = F.when(c("ai.confidence") == "confirmed", "Yes. ").otherwise("Probably. ")
    ai = F.when(c("ai.is_ai"), F.concat(sure, F.when(parts != "", F.concat(F.lit("It was "), parts, F.lit("."))).otherwise("The file carries AI marks."))).otherwise("No AI labels were found, which proves nothing: they are often removed.")
    state = F.element_at(F.create_map(*(F.lit(x) for kv in CREDENTIAL_STATES.items() for x in kv)), c("status"))
    known = c("created").isNotNull() | c("device").isNotNull()
    origin = F.concat(F.coalesce(F.concat(F.lit("Made on "), c("device")), F.lit("Made on an unknown device")), F.coalesce(F.concat(F.lit(", "), c("created")), F.lit("")), F.lit("."))
    changed = c("tampering")
    edited = (
        F.when(changed == "AI_GENERATED", "It was created by software rather than recorded.").when(changed == "TAMPERED", "Yes, there are clear signs that it was changed.")
        .when(changed.isin("RE_ENCODED", "EDITED_LATER"), "It was saved again after it was made.").otherwise("No signs of editing were found.")
    )
    found = F.array_compact(
        F.array(
            row(TITLES[0], info, first),
            row(TITLES[1], F.when(c("ai.is_ai"), "ai").otherwise(info), ai),
            F.when(c("status").isNotNull(), row(TITLES[2], state, c("headline"))),
            row(TITLES[3], F.when(known, info).otherwise("warn"), F.when(known, origin).otherwise("The file doesn't say when or on what device it was made.")),
            row(TITLES[4], F.when(changed == "TAMPERED", "bad").when(changed.isin("RE_ENCODED", "EDITED_LATER"), "warn").when(changed == "AI_GENERATED", info).otherwise("good"), edited),
        )
    )
    return rows.select("path", F.posexplode(found).alias("place", "r")).select("path", "place", "r.*")


def pictures_report(files: DataFrame, anchors: DataFrame, now: Column | None = None) -> DataFrame:
    """The report of picture files (path, format, content): credentials and AI verdict from one walk, sizes and tags from
    another; the rest are expressions and joins by path."""
    f = files.withColumn("raw", ai_origin.raw_text(F.col("content"))).withColumn("size", F.octet_length("content").cast("bigint"))
    v = signatures.verdict(walk(f, keep=("raw", "size"), every=True), anchors, now, raw=F.col("raw"), size=F.col("size"), said=signatures.said())
    b = boxes(files)
    tags = media.tags(b).unionByName(media.exif_tags(b))
    told = ai_origin.with_tags(v.select("path", "raw", "size", "status", "headline", signatures.credentials().alias("credentials")), tags)
    ai = ai_origin.judged(told.select("path", "raw", "tags", "credentials")).select("path", F.struct("is_ai", "confidence", "tool", "model").alias("ai"))
    of = lambda k: F.get(F.filter("tags", lambda t: t["key"] == k), 0)["value"]
    device = F.nullif(F.concat_ws(" ", of("Make"), of("Model")), F.lit(""))
    facts = told.select("path", "size", "status", "headline", F.coalesce(of("DateTimeOriginal"), of("ModifyDate")).alias("created"), device.alias("device"))
    rows = facts.join(ai, "path").join(media.pictures(b), "path", "left")
    none = {"seconds": "double", "has_sound": "boolean"}
    changed = F.when(F.col("ai.is_ai"), "AI_GENERATED").when(F.col("status") == "invalid", "TAMPERED").otherwise("AUTHENTIC_ORIGINAL")
    return summary(rows.withColumn("kind", F.lit("image")).withColumn("tampering", changed).select("*", *(F.lit(None).cast(t).alias(k) for k, t in none.items())))
