"""Streams of film and compressed audio, and the properties of documents, by column expressions on box rows.

What a file doesn't say is null: no default sizes, rates or codecs are filled in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .media import be, le, utf8

# Codec names of sample entries of ISO media and of Matroska codec ids.
ENTRY_CODECS = {"avc1": "h264", "hvc1": "hevc", "hev1": "hevc", "vp09": "vp9", "av01": "av1", "mp4a": "aac", "alac": "alac", "Opus": "opus"}
MATROSKA_CODECS = {
    "V_VP8": "vp8", "V_VP9": "vp9", "V_AV1": "av1", "V_MPEG4/ISO/AVC": "h264", "V_MPEGH/ISO/HEVC": "hevc", "V_MPEG4/ISO/ASP": "mpeg4", "V_MS/VFW/FOURCC": "vfw_fourcc",
    "A_OPUS": "opus", "A_VORBIS": "vorbis", "A_AAC": "aac", "A_FLAC": "flac", "A_AC3": "ac3", "A_EAC3": "eac3", "A_DTS": "dts", "A_MPEG/L3": "mp3", "A_PCM/INT/LIT": "pcm_s16le",
}
# Sampling rates of AAC by index.
AAC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
# What boxes of ISO media are.
BOX_TEXTS = {
    "ftyp": "File Type & Brand Compatibility Atom", "moov": "Movie Metadata Container Atom", "mvhd": "Movie Header (Timescale & Duration)", "trak": "Track Container (Video/Audio/Subtitles)",
    "tkhd": "Track Header (Dimensions & Volume)", "mdia": "Media Container Atom", "mdhd": "Media Header Atom", "hdlr": "Handler Reference Atom", "minf": "Media Information Container",
    "stbl": "Sample Table Container Atom", "stsd": "Sample Description (Codecs & Specs)", "stts": "Time-to-Sample Table", "stss": "Sync Sample Table (Keyframes)", "stsc": "Sample-to-Chunk Table",
    "stsz": "Sample Size Table", "stco": "Chunk Offset Table (32-bit)", "co64": "Chunk Offset Table (64-bit)", "mdat": "Media Data Payload (Raw Video/Audio Frames)", "free": "Free Space / Padding",
    "udta": "User Data & Metadata Atom", "meta": "Metadata Container Atom", "ilst": "iTunes Metadata Tags Container",
}


def lookup(names: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), key)


def number(data: Column) -> Column:
    """Unsigned big-endian integer of all bytes (up to 7)."""
    return F.conv(F.hex(data), 16, 10).cast("bigint")


def ieee(data: Column) -> Column:
    """Value of a big-endian float of 4 or 8 bytes; null for other sizes, infinities and what isn't a number."""
    high, low = be(data, 0, 4), be(data, 4, 4)
    wide = F.octet_length(data) == 8
    sign = F.when(F.shiftright(high, 31) == 1, -1.0).otherwise(1.0)
    exponent = F.when(wide, F.shiftright(high, 20).bitwiseAND(F.lit(2047))).otherwise(F.shiftright(high, 23).bitwiseAND(F.lit(255)))
    fraction = F.when(wide, high.bitwiseAND(F.lit(0xFFFFF)) / F.lit(2.0**20) + low / F.lit(2.0**52)).otherwise(high.bitwiseAND(F.lit(0x7FFFFF)) / F.lit(2.0**23))
    bias, top = F.when(wide, 1023).otherwise(127), F.when(wide, 2047).otherwise(255)
    value = F.when(exponent == 0, fraction * F.pow(F.lit(2.0), 1 - bias)).otherwise((fraction + 1) * F.pow(F.lit(2.0), exponent - bias))
    return F.when(F.octet_length(data).isin(4, 8) & (exponent < top), sign * value)


def _numbered(boxes: DataFrame, opener: str) -> DataFrame:
    """The boxes with ``track``: how many boxes named opener came up to them in their file, less one."""
    w = Window.partitionBy("path").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return boxes.withColumn("track", F.count_if(F.col("box") == opener).over(w).cast("int") - 1).where("track >= 0")


def _first(box: str, value: Column) -> Column:
    return F.min_by(value, F.when((F.col("box") == box) & value.isNotNull(), F.col("ordinal")))


def aac_config(entry: Column) -> Column:
    """struct(object_type, sample_rate, channels) of the decoder configuration inside a sample entry; null without one."""
    size = "(?:[89A-F].){0,3}[0-7]."
    asc = F.regexp_extract(F.hex(entry), f"65736473.{{8}}03{size}.{{4}}(?:00|80.{{4}}|20.{{4}})04{size}.{{26}}05{size}(.{{4,10}})", 1)
    word = F.rpad(asc, 10, "0")
    bits = F.conv(word, 16, 10).cast("bigint")
    field = lambda at, n: F.shiftright(bits, 40 - at - n).bitwiseAND(F.lit((1 << n) - 1)).cast("bigint")
    at = field(5, 4)
    explicit = at == 15
    channels = F.when(explicit, field(33, 4)).otherwise(field(9, 4))
    rate = F.when(explicit, field(9, 24)).otherwise(F.get(F.array(*(F.lit(r) for r in AAC_RATES)), at.cast("int")))
    return F.when(asc != "", F.struct(field(0, 5).alias("object_type"), rate.cast("bigint").alias("sample_rate"), F.when(channels == 7, 8).when(channels.between(1, 6), channels).cast("bigint").alias("channels")))


def mp4_streams(boxes: DataFrame) -> DataFrame:
    """path, track, kind (video, audio or the handler), codec, width, height, channels, sample_rate, bits, duration of each track."""
    b = _numbered(boxes.where("format = 'mp4' AND (box = 'moov.trak' OR box LIKE 'moov.trak.mdia.%')"), "moov.trak")
    x, at = F.col("payload"), "moov.trak.mdia."
    wide = be(x, 0, 1) == 1
    scale = F.when(wide, be(x, 20, 4)).otherwise(be(x, 12, 4))
    ticks = F.when(wide, be(x, 25, 7)).otherwise(be(x, 16, 4))
    g = b.groupBy("path", "track").agg(
        _first(at + "hdlr", F.decode(F.substring(x, 9, 4), "ISO-8859-1")).alias("handler"), _first(at + "minf.stbl.stsd", x).alias("entry"), _first(at + "mdhd", F.try_divide(ticks.cast("double"), scale)).alias("duration")
    )
    e = F.col("entry")
    code = F.decode(F.substring(e, 13, 4), "ISO-8859-1")
    kind = F.when(F.col("handler") == "vide", "video").when(F.col("handler") == "soun", "audio").otherwise(F.col("handler"))
    g = g.select("path", "track", "duration", kind.alias("kind"), F.coalesce(lookup(ENTRY_CODECS, code), F.nullif(code, F.lit(""))).alias("codec"), "entry", aac_config(e).alias("aac"))
    video, audio = F.col("kind") == "video", F.col("kind") == "audio"
    return g.select(
        "path", "track", "kind", "codec", F.when(video, be(e, 40, 2)).alias("width"), F.when(video, be(e, 42, 2)).alias("height"),
        F.when(audio, F.coalesce("aac.channels", be(e, 32, 2))).alias("channels"), F.when(audio, F.coalesce("aac.sample_rate", be(e, 40, 2))).alias("sample_rate"),
        F.when(audio, be(e, 34, 2)).alias("bits"), "duration",
    )


def mpeg_streams(boxes: DataFrame) -> DataFrame:
    """path, codec, version, layer, channels, sample_rate, bitrate, vbr, duration of MPEG audio; by its count of frames or else by its size."""
    text = F.when(F.col("format") == "mp3", F.decode("payload", "ISO-8859-1"))
    fact = lambda k: F.min(F.when(F.col("box") == f"frame.{k}", text))
    keys = ("version", "layer", "channels", "sample_rate", "bitrate", "samples", "count", "bytes", "vbr")
    g = boxes.where("box LIKE 'frame.%'").groupBy("path").agg(*(fact(k).alias(k) for k in keys), F.max("size").alias("size"))
    n = lambda k: F.col(k).cast("bigint")
    counted = F.when(n("count") > 0, n("count") * n("samples") / n("sample_rate"))
    duration = F.coalesce(counted, n("size") * 8.0 / n("bitrate"))
    bitrate = F.when(counted.isNotNull(), F.floor(F.coalesce(n("bytes"), n("size")) * 8.0 / counted + 0.5)).otherwise(n("bitrate"))
    return g.select(
        "path", F.concat(F.lit("mp"), "layer").alias("codec"), "version", n("layer").alias("layer"), n("channels").alias("channels"), n("sample_rate").alias("sample_rate"),
        bitrate.alias("bitrate"), F.coalesce(F.col("vbr") == "1", F.lit(False)).alias("vbr"), duration.alias("duration"),
    )


def ogg_streams(boxes: DataFrame) -> DataFrame:
    """path, codec, channels, sample_rate, duration of Ogg files; Opus counts 48,000 samples a second after its pre-skip."""
    x = F.col("payload")
    opus, vorbis, flac = (x.cast("string").startswith(m) for m in ("OpusHead", "\1vorbis", "\x7fFLAC"))
    ident = F.when(F.col("box") == "ident", F.when(opus, F.struct(F.lit("opus").alias("codec"), be(x, 9, 1).alias("channels"), le(x, 12, 4).alias("rate"), le(x, 10, 2).alias("skip")))
        .when(vorbis, F.struct(F.lit("vorbis").alias("codec"), be(x, 11, 1).alias("channels"), le(x, 12, 4).alias("rate"), F.lit(0).cast("bigint").alias("skip")))
        .when(flac, F.struct(F.lit("flac").alias("codec"), F.lit(None).cast("bigint").alias("channels"), F.lit(None).cast("bigint").alias("rate"), F.lit(0).cast("bigint").alias("skip"))))
    b = boxes.where("format = 'ogg' AND box IN ('ident', 'last')").select("path", "ordinal", ident.alias("i"), F.when(F.col("box") == "last", le(x, 0, 7)).alias("granule"))
    g = b.groupBy("path").agg(F.min_by("i", F.when(F.col("i").isNotNull(), F.col("ordinal"))).alias("i"), F.max("granule").alias("granule")).where("i IS NOT NULL")
    clock = F.when(F.col("i.codec") == "opus", 48000).otherwise(F.col("i.rate"))
    inside = (F.col("granule") > 0) & (F.col("granule") < 2**52)
    duration = F.when(inside, F.try_divide(F.greatest(F.lit(0), F.col("granule") - F.col("i.skip")).cast("double"), clock))
    return g.select("path", "i.codec", "i.channels", F.col("i.rate").alias("sample_rate"), duration.alias("duration"))


TRACK = "18538067.1654AE6B.AE"
INFO = "18538067.1549A966."


def matroska_streams(boxes: DataFrame) -> DataFrame:
    """path, track, kind, codec, title, language, width, height, frame_rate, channels, sample_rate, bits of each track."""
    b = _numbered(boxes.where(f"format = 'webm' AND box LIKE '{TRACK}%'"), TRACK)
    x = F.col("payload")
    text = F.regexp_replace(utf8(x), "\0+$", "")
    fact = lambda name, value: _first(f"{TRACK}.{name}", value)
    g = b.groupBy("path", "track").agg(
        fact("83", number(x)).alias("t"), fact("86", text).alias("id"), fact("536E", text).alias("title"), fact("22B59C", text).alias("language"), fact("23E383", number(x)).alias("frame"),
        fact("E0.B0", number(x)).alias("width"), fact("E0.BA", number(x)).alias("height"), fact("E1.9F", number(x)).alias("channels"), fact("E1.B5", ieee(x)).alias("rate"), fact("E1.6264", number(x)).alias("bits"),
    )
    kind = F.when(F.col("t") == 1, "video").when(F.col("t") == 2, "audio").when(F.col("t") == 17, "subtitle").otherwise("data")
    return g.select(
        "path", "track", kind.alias("kind"), F.coalesce(lookup(MATROSKA_CODECS, F.col("id")), F.lower("id")).alias("codec"), "title", F.nullif("language", F.lit("und")).alias("language"), "width", "height",
        F.round(F.try_divide(F.lit(1e9), F.col("frame")), 3).alias("frame_rate"), "channels", F.floor(F.col("rate") + 0.5).alias("sample_rate"), "bits",
    )


def matroska_movies(boxes: DataFrame) -> DataFrame:
    """path, doctype, title, muxer, writer, created, duration in seconds of Matroska files."""
    x = F.col("payload")
    text = F.regexp_replace(utf8(x), "\0+$", "")
    b = boxes.where("format = 'webm'")
    # Nanoseconds since 2001 fill seven bytes until 2103; the eighth is a sign.
    created = F.timestamp_micros(F.floor(be(x, 1, 7) / 1000).cast("bigint") + F.lit(978307200000000))
    g = b.groupBy("path").agg(
        _first("1A45DFA3.4282", text).alias("doctype"), _first(INFO + "7BA9", text).alias("title"), _first(INFO + "4D80", text).alias("muxer"), _first(INFO + "5741", text).alias("writer"),
        _first(INFO + "4461", created).alias("created"), _first(INFO + "4489", ieee(x)).alias("d"), _first(INFO + "2AD7B1", number(x)).alias("scale"),
    )
    return g.select("path", "doctype", "title", "muxer", "writer", "created", (F.col("d") * F.coalesce("scale", F.lit(1_000_000)) / F.lit(1e9)).alias("duration"))


def box_texts(boxes: DataFrame) -> DataFrame:
    """path, ordinal, box, text: what each box of ISO media is."""
    return boxes.where("format IN ('mp4', 'heif')").select("path", "ordinal", "box", F.coalesce(lookup(BOX_TEXTS, F.substring_index("box", ".", -1)), F.lit("ISO BMFF Atom Box")).alias("text"))


# Property names by document kind, as (key, part, XML element).
OFFICE = (
    ("Title", "core", "dc:title"), ("Subject", "core", "dc:subject"), ("Author", "core", "dc:creator"), ("LastModifiedBy", "core", "cp:lastModifiedBy"), ("Keywords", "core", "cp:keywords"),
    ("Description", "core", "dc:description"), ("Revision", "core", "cp:revision"), ("creation_time", "core", "dcterms:created"), ("modification_time", "core", "dcterms:modified"), ("LastPrinted", "core", "cp:lastPrinted"),
    ("Application", "app", "Application"), ("AppVersion", "app", "AppVersion"), ("Company", "app", "Company"), ("Template", "app", "Template"), ("Pages", "app", "Pages"), ("Words", "app", "Words"),
    ("Slides", "app", "Slides"), ("TotalEditingTime", "app", "TotalTime"),
)
OPEN = (
    ("Title", "dc:title"), ("Subject", "dc:subject"), ("Description", "dc:description"), ("Keywords", "meta:keyword"), ("Author", "meta:initial-creator"), ("LastModifiedBy", "dc:creator"),
    ("creation_time", "meta:creation-date"), ("modification_time", "dc:date"), ("Software", "meta:generator"), ("Revision", "meta:editing-cycles"),
)


def element(xml: Column, name: str) -> Column:
    """Unescaped text of the first element of a name; null if it is missing or empty."""
    inner = F.trim(F.regexp_replace(F.regexp_extract(xml, f"(?is)<{name}(?:\\s[^>]*)?>(.*?)</{name}>", 1), "<[^>]*>", ""))
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        inner = F.replace(inner, F.lit(mark), F.lit(char))
    return F.nullif(inner, F.lit(""))


def _archives(boxes: DataFrame) -> DataFrame:
    name, text = F.col("box"), utf8(F.col("payload"))
    has = lambda when: F.coalesce(F.bool_or(when), F.lit(False))
    part = lambda n: F.min(F.when(name == n, text))
    g = boxes.where("format = 'zip' AND box <> 'error'").groupBy("path").agg(
        has(name == "[Content_Types].xml").alias("office"), F.trim(part("mimetype")).alias("mimetype"), part("docProps/core.xml").alias("core"), part("docProps/app.xml").alias("app"), part("meta.xml").alias("meta"),
        *(has(name.startswith(f"{d}/")).alias(d) for d in ("word", "xl", "ppt")), F.count(F.lit(1)).alias("n_files"),
        F.count_if(name.rlike(r"(?i)(^|/)(media|Pictures)/") & ~name.endswith("/")).alias("n_media"),
    )
    m = F.col("mimetype")
    office = F.when(F.col("word"), "docx").when(F.col("xl"), "xlsx").when(F.col("ppt"), "pptx").otherwise("ooxml")
    opened = F.when(m.contains("text"), "odt").when(m.contains("spreadsheet"), "ods").otherwise("odp")
    return g.withColumn("kind", F.when(F.col("office"), office).when(m.startswith("application/vnd.oasis.opendocument"), opened).otherwise("zip"))


def archives(boxes: DataFrame) -> DataFrame:
    """path, kind (docx, xlsx, pptx, ooxml, odt, ods, odp or zip), is_document, n_files, n_media of ZIP files."""
    return _archives(boxes).select("path", "kind", (F.col("kind") != "zip").alias("is_document"), "n_files", "n_media")


def document_tags(boxes: DataFrame) -> DataFrame:
    """path, key, value of the properties that office documents state."""
    a = _archives(boxes).where("kind <> 'zip'")
    both = lambda office, opened: F.when(F.col("office"), office).otherwise(opened)
    none = F.lit(None).cast("string")
    found = {k: both(element(F.col(part), n), none) for k, part, n in OFFICE}
    found["TotalEditingTime"] = F.concat(found["TotalEditingTime"], F.lit(" min"))
    made = F.coalesce(F.concat_ws(" ", F.nullif(found["Application"], F.lit("")), found["AppVersion"]), none)
    found["Software"] = both(F.when(found["Application"].isNotNull(), made).otherwise(found["Author"]), none)
    for k, n in OPEN:
        found[k] = both(found[k], element(F.col("meta"), n))
    stats = F.regexp_extract("meta", "(?i)<meta:document-statistic([^>]*)>", 1)
    for k, n in (("Pages", "page"), ("Words", "word")):
        found[k] = both(found[k], F.nullif(F.regexp_extract(stats, f'{n}-count="(\\d+)"', 1), F.lit("")))
    rows = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in found.items()))
    return a.select("path", F.explode(rows).alias("r")).select("path", "r.key", "r.value").where("value IS NOT NULL")


def archive_head(boxes: DataFrame, n: int = 300) -> DataFrame:
    """path, place, name, offset, size of the first n entries of each ZIP file, for a listing."""
    w = Window.partitionBy("path").orderBy("ordinal")
    rows = boxes.where("format = 'zip' AND box <> 'error'").select("path", F.row_number().over(w).alias("place"), F.col("box").alias("name"), "offset", "size")
    return rows.where(F.col("place") <= n)
