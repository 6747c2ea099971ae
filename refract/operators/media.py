"""Streams and tags from box rows, by column expressions on payloads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.pdf import KEYS as PDF_KEYS

# Names of RIFF INFO, ID3 and iTunes entries.
INFO_TAGS = {"INAM": "title", "IART": "artist", "IPRD": "album", "ICRD": "date", "IGNR": "genre", "ICMT": "comment", "ISFT": "software", "IENG": "engineer"}
ID3_TAGS = {"TIT2": "title", "TPE1": "artist", "TALB": "album", "TYER": "date", "TDRC": "date", "TCON": "genre", "TSSE": "encoder", "TENC": "encoded_by", "COMM": "comment", "TCOM": "composer", "TRCK": "track", "TCOP": "copyright"}
ITUNES_TAGS = {
    "\u00a9nam": "title", "\u00a9ART": "artist", "\u00a9alb": "album", "\u00a9day": "date", "\u00a9gen": "genre", "\u00a9too": "encoder", "\u00a9wrt": "composer", "desc": "description", "cprt": "copyright",
    "\u00a9mak": "Make", "\u00a9mod": "Model", "\u00a9swr": "Software", "\u00a9xyz": "Location", "\u00a9cmt": "comment", "\u00a9des": "description", "ldes": "long_description", "aART": "album_artist",
    "\u00a9grp": "grouping", "titl": "title", "auth": "author", "dscp": "description", "mak ": "Make", "mod ": "Model", "swr ": "Software",
}
DOTTED_TAGS = {
    "com.apple.quicktime.make": "Make", "com.apple.quicktime.model": "Model", "com.apple.quicktime.software": "Software", "com.apple.quicktime.creationdate": "creation_time",
    "com.apple.quicktime.location.ISO6709": "Location", "com.apple.quicktime.author": "author", "com.apple.quicktime.title": "title", "com.apple.quicktime.description": "description",
    "com.apple.quicktime.comment": "comment", "com.android.manufacturer": "Make", "com.android.model": "Model", "com.android.version": "Software",
}
PNG_TAGS = {
    "parameters": "ai_prompt", "prompt": "ai_prompt", "creation time": "creation_time", "software": "Software", "make": "Make", "model": "Model", "device": "Model", "camera": "Model", "lens": "LensModel",
    "lensmodel": "LensModel", "host computer": "HostComputer", "hostcomputer": "HostComputer",
}
IPTC_TAGS = {
    "5": "IPTC Title", "25": "IPTC Keywords", "40": "IPTC Instructions", "55": "IPTC Date Created", "80": "IPTC Creator", "90": "IPTC City", "101": "IPTC Country", "105": "IPTC Headline",
    "110": "IPTC Credit", "115": "IPTC Source", "116": "IPTC Copyright", "120": "IPTC Caption",
}


def le(payload: Column, at: int, n: int) -> Column:
    """Unsigned little-endian integer of n bytes (up to 7)."""
    parts = [F.lpad(F.hex(F.substring(payload, at + i + 1, 1)), 2, "0") for i in reversed(range(n))]
    return F.conv(F.concat(*parts), 16, 10).cast("bigint")


def be(payload: Column, at: int, n: int) -> Column:
    """Unsigned big-endian integer of n bytes (up to 7)."""
    return F.conv(F.hex(F.substring(payload, at + 1, n)), 16, 10).cast("bigint")


def latin(payload: Column) -> Column:
    """Text up to the first NUL."""
    return F.trim(F.substring_index(F.decode(payload, "ISO-8859-1"), "\0", 1))


def utf8(data: Column) -> Column:
    """Text of UTF-8 bytes; what isn't valid becomes the replacement character instead of an error."""
    return F.make_valid_utf8(data.cast("string"))


def utf16(data: Column) -> Column:
    """Text of UTF-16 bytes, big-endian without a mark; damaged pairs become the replacement character."""

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        name = lambda b: "utf-16" if b[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-16-be"
        return values.map(lambda b: None if b is None else bytes(b).decode(name(bytes(b)), "replace"))

    return decode(data)


def wav_streams(boxes: DataFrame) -> DataFrame:
    """path, codec, channels, sample_rate, bits, duration of RIFF/WAVE files."""
    b = boxes.where("format = 'wav' AND box IN ('fmt ', 'data')")
    f = b.groupBy("path").agg(F.min_by("payload", F.when(F.col("box") == "fmt ", F.col("ordinal"))).alias("fmt"), F.sum(F.when(F.col("box") == "data", F.col("size") - 8)).alias("bytes"))
    x = F.col("fmt")
    bits = le(x, 14, 2)
    rate = le(x, 8, 4)
    codec = F.when(le(x, 0, 2) == 3, F.concat(F.lit("pcm_f"), bits.cast("string"), F.lit("le"))).when(bits == 8, "pcm_u8").otherwise(F.concat(F.lit("pcm_s"), bits.cast("string"), F.lit("le")))
    return f.where(x.isNotNull()).select("path", codec.alias("codec"), le(x, 2, 2).alias("channels"), le(x, 4, 4).alias("sample_rate"), bits.alias("bits"), F.try_divide(F.col("bytes").cast("double"), rate).alias("duration"))


def flac_streams(boxes: DataFrame) -> DataFrame:
    x = F.col("payload")
    packed = be(x, 10, 4)
    rate = F.shiftright(packed, 12)
    samples = F.pmod(be(x, 13, 1), F.lit(16)) * F.lit(4294967296) + be(x, 14, 4)
    channels = F.pmod(F.shiftright(packed, 9), F.lit(8)) + 1
    bits = F.pmod(F.shiftright(packed, 4), F.lit(32)) + 1
    return boxes.where("box = 'STREAMINFO'").select("path", F.lit("flac").alias("codec"), channels.alias("channels"), rate.alias("sample_rate"), bits.alias("bits"), F.try_divide(samples.cast("double"), rate).alias("duration"))


def pictures(boxes: DataFrame) -> DataFrame:
    """path, width, height of PNG, JPEG, GIF and WebP files; null where a file doesn't say."""
    x, box, kind = F.col("payload"), F.col("box"), F.col("format")
    lossless = le(x, 1, 4)
    frame = (kind == "jpeg") & box.isin("C0", "C1", "C2", "C3")
    rows = boxes.select(
        "path", "ordinal",
        F.when((kind == "png") & (box == "IHDR"), F.struct(be(x, 0, 4).alias("w"), be(x, 4, 4).alias("h")))
        .when(frame, F.struct(be(x, 3, 2).alias("w"), be(x, 1, 2).alias("h")))
        .when((kind == "gif") & (box == "file"), F.struct(le(x, 6, 2).alias("w"), le(x, 8, 2).alias("h")))
        .when((kind == "webp") & (box == "VP8X"), F.struct((le(x, 4, 3) + 1).alias("w"), (le(x, 7, 3) + 1).alias("h")))
        .when((kind == "webp") & (box == "VP8 "), F.struct(le(x, 6, 2).bitwiseAND(F.lit(16383)).alias("w"), le(x, 8, 2).bitwiseAND(F.lit(16383)).alias("h")))
        .when((kind == "webp") & (box == "VP8L"), F.struct((lossless.bitwiseAND(F.lit(16383)) + 1).alias("w"), (F.shiftright(lossless, 14).bitwiseAND(F.lit(16383)) + 1).alias("h"))).alias("size"),
    )
    first = rows.where("size IS NOT NULL").groupBy("path").agg(F.min_by("size", "ordinal").alias("size"))
    return first.select("path", F.col("size.w").alias("width"), F.col("size.h").alias("height"))


def movies(boxes: DataFrame) -> DataFrame:
    """path, timescale, duration in seconds, created (timestamp) of MP4 files, from the movie header."""
    x = F.col("payload")
    wide = be(x, 0, 1) == 1
    at = lambda a, b, n=4: F.when(wide, be(x, b, n)).otherwise(be(x, a, n))
    created = F.when(wide, be(x, 5, 7)).otherwise(be(x, 4, 4))
    scale = at(12, 20)
    ticks = F.when(wide, be(x, 25, 7)).otherwise(be(x, 16, 4))
    return boxes.where("format = 'mp4' AND box = 'moov.mvhd'").select(
        "path", scale.alias("timescale"), F.try_divide(ticks.cast("double"), scale).alias("duration"), F.when(created > 0, F.timestamp_seconds(created - 2082844800)).alias("created")
    )


def tags(boxes: DataFrame) -> DataFrame:
    """path, ordinal, key, value of textual entries: RIFF INFO and bext, PNG text and time, ID3 frames, JPEG comments, XMP, Vorbis comments, ISO media user data."""
    x, box, kind = F.col("payload"), F.col("box"), F.col("format")
    text = F.decode(x, "ISO-8859-1")
    pairs = lambda names: F.create_map(*(F.lit(v) for kv in names.items() for v in kv))
    info = F.try_element_at(pairs(INFO_TAGS), F.substring(box, 6, 4))
    frame = F.try_element_at(pairs(ID3_TAGS), box)
    row = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    body = F.expr("substring(payload, 2)")
    id3_text = F.when(be(x, 0, 1) == 1, utf16(body)).when(be(x, 0, 1) == 3, utf8(body)).otherwise(F.decode(body, "ISO-8859-1"))
    named = F.substring_index(text, "\0", 1)
    routed = F.try_element_at(pairs(PNG_TAGS), F.lower(F.trim(named)))
    png_key = F.when(F.lower(named).contains("xmp"), "xmp").otherwise(F.coalesce(routed, named))
    after = F.expr("substring(payload, instr(decode(payload, 'ISO-8859-1'), char(0)) + 1)")
    png_value = F.when(box == "iTXt", utf8(after)).otherwise(F.decode(after, "ISO-8859-1"))
    atom = F.try_element_at(pairs(ITUNES_TAGS), F.substring_index(F.substring_index(box, ".", -2), ".", 1))
    user = F.try_element_at(pairs(ITUNES_TAGS), F.substring_index(box, ".", -1))
    found = (
        F.when((kind == "wav") & info.isNotNull(), row(info, latin(x)))
        .when((kind == "wav") & (box == "bext"), row(F.lit("bext_originator"), latin(F.substring(x, 257, 32))))
        .when((kind == "png") & box.isin("tEXt", "zTXt", "iTXt"), row(png_key, png_value))
        .when((kind == "png") & (box == "tIME"), row(F.lit("modification_time"), F.format_string("%04d-%02d-%02dT%02d:%02d:%02dZ", be(x, 0, 2), *(be(x, i, 1) for i in range(2, 7)))))
        .when(kind.isin("flac", "ogg") & box.startswith("comment."), row(F.substring(box, 9, 1000), utf8(x)))
        .when((kind == "mp4") & F.endswith(box, F.lit(".data")) & atom.isNotNull(), row(atom, F.trim(utf8(F.expr("substring(payload, 9)")))))
        .when((kind == "mp4") & box.startswith("moov.udta.") & user.isNotNull(), row(user, F.trim(utf8(F.expr("substring(payload, 5)")))))
        .when((kind == "mp3") & frame.isNotNull(), row(frame, F.trim(F.replace(id3_text, F.lit("\0"), F.lit("")))))
        .when((kind == "jpeg") & (box == "FE"), row(F.lit("Comment"), latin(x)))
        .when((kind == "pdf") & (box == "xmp"), row(F.lit("xmp"), utf8(x)))
        .when((kind == "pdf") & box.startswith("info."), row(F.substring(box, 6, 40), utf8(x)))
        .when((kind == "webp") & (box == "XMP "), row(F.lit("xmp"), utf8(x)))
        .when((kind == "jpeg") & (box == "E1") & text.contains("http://ns.adobe.com/xap/1.0/"), row(F.lit("xmp"), utf8(x)))
    )
    t = boxes.select("path", "ordinal", found.alias("t")).where("t IS NOT NULL AND t.value <> ''")
    return t.select("path", "ordinal", "t.key", "t.value")


def dotted_tags(boxes: DataFrame) -> DataFrame:
    """path, ordinal, key, value of reverse-domain metadata: the n-th name of a ``keys`` box goes with the values of item n."""
    b = boxes.where("format = 'mp4'")
    listed = F.expr("substring(payload, 9)")
    # The names of a list are cut at their own sizes by a fold over its bytes.
    step = lambda acc, _: F.when(be(acc["rest"], 0, 4) >= 8, F.struct(
        F.concat(acc["names"], F.array(utf8(F.substring(acc["rest"], F.lit(9), be(acc["rest"], 0, 4).cast("int") - 8)))).alias("names"),
        F.substring(acc["rest"], be(acc["rest"], 0, 4).cast("int") + 1, F.octet_length(acc["rest"])).alias("rest"),
    )).otherwise(acc)
    start = F.struct(F.array().cast("array<string>").alias("names"), listed.alias("rest"))
    many = F.least(be(F.col("payload"), 4, 4), F.floor(F.octet_length("payload") / 8)).cast("int")
    names = F.aggregate(F.when(many > 0, F.sequence(F.lit(1), many)).otherwise(F.array().cast("array<int>")), start, step)["names"]
    keys = b.where(F.col("box").endswith(".keys")).select("path", F.posexplode(names).alias("i", "name"))
    key = F.try_element_at(F.create_map(*(F.lit(v) for kv in DOTTED_TAGS.items() for v in kv)), F.col("name"))
    keys = keys.select("path", (F.col("i") + 1).cast("bigint").alias("item"), key.alias("key")).where("key IS NOT NULL")
    item = F.substring_index(F.substring_index("box", ".", -2), ".", 1)
    item = F.when(F.length(item) == 4, be(F.encode(item, "ISO-8859-1"), 0, 4))
    values = b.where(F.col("box").contains(".ilst.") & F.col("box").endswith(".data")).select("path", "ordinal", item.alias("item"), F.trim(utf8(F.expr("substring(payload, 9)"))).alias("value"))
    return values.join(keys, ["path", "item"]).where("value <> ''").select("path", "ordinal", "key", "value")


def iptc_tags(boxes: DataFrame) -> DataFrame:
    """path, key, value of the press record: the first value of a data set, all keywords joined by a comma and a space."""
    name = F.try_element_at(F.create_map(*(F.lit(v) for kv in IPTC_TAGS.items() for v in kv)), F.substring("box", 8, 3))
    rows = boxes.where("box LIKE 'iptc.2.%'").select("path", "ordinal", name.alias("key"), F.trim(utf8(F.col("payload"))).alias("value")).where("key IS NOT NULL AND value <> ''")
    all_values = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "value"))), lambda v: v["value"])
    g = rows.groupBy("path", "key").agg(all_values.alias("v"))
    return g.select("path", "key", F.when(F.col("key") == "IPTC Keywords", F.array_join("v", ", ")).otherwise(F.get("v", 0)).alias("value"))


# Names of EXIF entries by directory and tag.
EXIF_TAGS = {
    "0000.010F": "Make", "0000.0110": "Model", "0000.0131": "Software", "0000.0132": "ModifyDate", "0000.013B": "Artist", "0000.8298": "Copyright", "0000.010E": "ImageDescription", "0000.0112": "Orientation",
    "8769.829A": "ExposureTime", "8769.829D": "FNumber", "8769.8827": "ISO", "8769.9003": "DateTimeOriginal", "8769.9209": "Flash", "8769.920A": "FocalLength", "8769.A002": "ExifImageWidth", "8769.A003": "ExifImageHeight",
    "8769.A434": "LensModel", "8769.A431": "BodySerialNumber", "8769.9286": "UserComment", "8769.9204": "ExposureBias", "8769.9004": "DateTimeDigitized", "8769.A433": "LensMake", "0000.013C": "HostComputer",
}


def exif_tags(boxes: DataFrame) -> DataFrame:
    """path, ordinal, key, value of known EXIF entries; exposure as 1/n s, aperture as f/x, focal length in mm."""
    name = F.try_element_at(F.create_map(*(F.lit(x) for kv in EXIF_TAGS.items() for x in kv)), F.substring("box", 6, 9))
    rows = boxes.where("box LIKE 'exif.%'").select("path", "ordinal", name.alias("key"), F.trim(utf8(F.col("payload"))).alias("t")).where("key IS NOT NULL AND t <> ''")
    n, d = (F.try_element_at(F.split("t", "/"), F.lit(i)).cast("double") for i in (1, 2))
    fraction = F.when(F.col("key").isin("ExposureTime", "FNumber", "FocalLength", "ExposureBias"), F.when(d == 0, 0.0).otherwise(n / d))
    speed = F.when((fraction > 0) & (fraction < 1), F.concat(F.lit("1/"), F.floor(1 / fraction + 0.5).cast("string"), F.lit(" s"))).otherwise(F.concat(fraction.cast("string"), F.lit(" s")))
    value = (
        F.when(F.col("key") == "ExposureTime", speed).when(F.col("key") == "FNumber", F.format_string("f/%.1f", fraction)).when(F.col("key") == "FocalLength", F.format_string("%.1f mm", fraction))
        .when(F.col("key") == "ExposureBias", F.format_string("%+.1f EV", fraction)).when(F.col("key") == "Flash", F.when(F.col("t").cast("int").bitwiseAND(F.lit(1)) == 1, "Fired").otherwise("Did not fire")).otherwise(F.col("t"))
    )
    return rows.select("path", "ordinal", "key", value.alias("value"))


def exif_places(boxes: DataFrame) -> DataFrame:
    """path, latitude, longitude, altitude in degrees and metres; south, west and below the sea are negative."""
    tag = lambda t: F.min(F.when(F.col("box") == f"exif.8825.{t}", utf8(F.col("payload"))))
    g = boxes.where("box LIKE 'exif.8825.%'").groupBy("path").agg(*(tag(t).alias(n) for t, n in (("0001", "ns"), ("0002", "lat"), ("0003", "ew"), ("0004", "lon"), ("0005", "below"), ("0006", "alt"))))

    def degrees(c: str, ref: str) -> Column:
        value = lambda x: F.coalesce(F.try_divide(F.get(F.split(x, "/"), 0).cast("double"), F.get(F.split(x, "/"), 1).cast("double")), F.lit(0.0))
        return F.aggregate(F.reverse(F.split(c, " ")), F.lit(0.0), lambda acc, x: acc / 60 + value(x)) * F.when(F.col(ref).isin("S", "W"), -1.0).otherwise(1.0)

    height = F.try_divide(F.get(F.split("alt", "/"), 0).cast("double"), F.get(F.split("alt", "/"), 1).cast("double")) * F.when(F.col("below") == "1", -1.0).otherwise(1.0)
    return g.select("path", degrees("lat", "ns").alias("latitude"), degrees("lon", "ew").alias("longitude"), height.alias("altitude")).where("latitude IS NOT NULL AND longitude IS NOT NULL")


XMP_FIELDS = {"Make": "tiff:Make", "Model": "tiff:Model", "CreateDate": "xmp:CreateDate", "ModifyDate": "xmp:ModifyDate", "CreatorTool": "xmp:CreatorTool", "DigitalSourceType": "Iptc4xmpExt:DigitalSourceType", "Credit": "photoshop:Credit", "DocumentID": "xmpMM:DocumentID", "InstanceID": "xmpMM:InstanceID", "OriginalDocumentID": "xmpMM:OriginalDocumentID", "LensModel": "aux:Lens"}


def xmp_tags(rows: DataFrame) -> DataFrame:
    """path, ordinal, key, value of the fields of XMP texts (dates, camera, rights, ids, prompt), written as elements or as attributes."""
    field = lambda n: F.coalesce(F.nullif(F.regexp_extract("value", f"(?i)<{n}>\\s*([^<]+?)\\s*</{n}>", 1), F.lit("")), F.nullif(F.regexp_extract("value", f'(?i){n}="([^"]+)"', 1), F.lit("")))
    entries = F.create_map(*(x for k, n in XMP_FIELDS.items() for x in (F.lit(k), field(n))))
    return rows.where("key = 'xmp'").select("path", "ordinal", F.explode(entries).alias("key", "value")).where("value IS NOT NULL")


def xmp_history(rows: DataFrame) -> DataFrame:
    """path, ordinal, place, action, agent, at of the edit history of XMP texts."""
    steps = F.regexp_extract_all("value", F.lit(r"(?is)(<rdf:li\b[^>]*stEvt:action.*?(?:/>|</rdf:li>)|<rdf:li\b[^>]*>\s*<stEvt:.*?</rdf:li>)"), F.lit(1))
    field = lambda n: F.coalesce(F.nullif(F.regexp_extract("step", f'stEvt:{n}="([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract("step", f"<stEvt:{n}>\\s*([^<]*?)\\s*</stEvt:{n}>", 1), F.lit("")))
    h = rows.where("key = 'xmp'").select("path", "ordinal", F.posexplode(steps).alias("place", "step"))
    return h.select("path", "ordinal", "place", field("action").alias("action"), field("softwareAgent").alias("agent"), field("when").alias("at")).where("action IS NOT NULL")


def pdf_info(boxes: DataFrame) -> DataFrame:
    """path, version, information entries (the last one of a key), revisions and updates of PDF files.

    revisions: cross-reference sections along the chain of the file; updates: those that were appended after it was made
    (a linearized file is made with two); lost: the chain leads nowhere.
    """
    x, box = utf8(F.col("payload")), F.col("box")
    last = lambda k: F.nullif(F.max_by(x, F.when(box == f"info.{k}", F.col("offset"))), F.lit("")).alias(k)
    g = boxes.where("format = 'pdf'").groupBy("path").agg(
        F.min(F.when(box == "header", x)).alias("version"), *map(last, PDF_KEYS), F.count_if(box == "xref").cast("int").alias("revisions"),
        F.count_if(box == "linearized").alias("first"), F.bool_or(box == "xref.lost").alias("lost"),
    )
    made = F.when(F.col("first") > 0, 2).otherwise(1)
    return g.select("path", "version", *PDF_KEYS, "revisions", F.greatest(F.lit(0), F.col("revisions") - made).alias("updates"), "lost")


def heif_pictures(boxes: DataFrame) -> DataFrame:
    """path, width, height of HEIF and AVIF files: the size that the primary item's properties say.

    The primary item (pitm) is joined with its associations (ipma), and those with the n-th property (ipco); sizes of
    thumbnails and of the tiles of a grid belong to other items.
    """
    b, x = boxes.where("box LIKE 'meta.%'"), F.col("payload")
    primary = b.where("box = 'meta.pitm'").select("path", F.when(be(x, 0, 1) > 0, be(x, 4, 4)).otherwise(be(x, 4, 2)).alias("item"))
    numbers = F.transform(F.sequence(F.lit(0), F.shiftright(F.octet_length("payload"), 1) - 1), lambda i: F.conv(F.hex(F.substring(x, 2 * i + 1, F.lit(2))), 16, 10).cast("int"))
    tied = b.where("box LIKE 'meta.iprp.ipma.%' AND octet_length(payload) > 0").select("path", F.substring_index("box", ".", -1).cast("bigint").alias("item"), F.explode(numbers).alias("place"))
    placed = F.row_number().over(Window.partitionBy("path").orderBy("ordinal"))
    sizes = b.where("box LIKE 'meta.iprp.ipco.%' AND box NOT LIKE 'meta.iprp.ipco.%.%'").withColumn("place", placed).where("box = 'meta.iprp.ipco.ispe'")
    sizes = sizes.select("path", "place", be(x, 4, 4).alias("width"), be(x, 8, 4).alias("height"))
    return primary.join(tied, ["path", "item"]).join(sizes, ["path", "place"]).select("path", "width", "height").dropDuplicates(["path"])


def tiff_pictures(boxes: DataFrame) -> DataFrame:
    """path, width, height of TIFF files, from their first directory."""
    of = lambda t: F.min(F.when(F.col("box") == f"exif.0000.{t}", utf8(F.col("payload")).cast("bigint")))
    return boxes.where("format = 'tiff' AND box IN ('exif.0000.0100', 'exif.0000.0101')").groupBy("path").agg(of("0100").alias("width"), of("0101").alias("height"))
