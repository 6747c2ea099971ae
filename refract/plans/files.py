"""Queries over film, sound, picture and document files that are built from table rows, so what they say is known."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import pandas as pd
from pyspark.sql import functions as F

from ..operators import media, streams
from ..registry import query, table
from ..sources.containers import boxes


def box(kind: bytes, *data: bytes) -> bytes:
    body = b"".join(data)
    return struct.pack(">I", len(body) + 8) + kind + body


def film(key: int, name: str) -> bytes:
    """An ISO media file of a picture and a sound track, named twice in its user data."""

    def track(handler: bytes, entry: bytes, ticks: int) -> bytes:
        mdhd = box(b"mdhd", struct.pack(">IIIIII", 0, 0, 0, 1000, ticks, 0))
        stsd = box(b"stsd", struct.pack(">II", 0, 1), entry)
        return box(b"trak", box(b"mdia", mdhd, box(b"hdlr", bytes(8) + handler + bytes(13)), box(b"minf", box(b"stbl", stsd))))

    video = box(b"avc1", bytes(24), struct.pack(">HH", 640 + 16 * key, 360 + 8 * key), bytes(50))
    config = struct.pack(">H", 2 << 11 | 3 + key % 3 << 7 | 1 + key % 2 << 3)
    decoder = b"\4\x11\x40\x15" + bytes(11) + b"\5\2" + config
    audio = box(b"mp4a", bytes(16), struct.pack(">HHII", 2, 16, 0, 44100 << 16), box(b"esds", bytes(4) + b"\3" + bytes([3 + len(decoder)]) + b"\0\1\0" + decoder))
    item = lambda kind, text: box(kind, box(b"data", struct.pack(">II", 1, 0) + text.encode()))
    label = b"com.apple.quicktime.make"
    meta = box(b"meta", bytes(4), box(b"keys", struct.pack(">II", 0, 1), struct.pack(">I", 8 + len(label)) + b"mdta" + label), box(b"ilst", item(b"\0\0\0\1", f"maker {key}")))
    tags = box(b"udta", box(b"meta", bytes(4), box(b"ilst", item(b"\xa9nam", name), item(b"\xa9too", "refract"))))
    return box(b"ftyp", b"isom\0\0\2\0isom") + box(b"moov", track(b"vide", video, 2000 + 100 * key), track(b"soun", audio, 4000), meta, tags) + box(b"mdat", bytes(10_000))


def sound(key: int) -> bytes:
    """Layer III frames of 128 kbit/s at 44,100 Hz; every second file counts its frames in a header."""
    frame = b"\xff\xfb\x90\x00" + bytes(413)
    head = b"\xff\xfb\x90\x00" + bytes(32) + b"Xing" + struct.pack(">II", 1, 1000 + key)
    first = head + bytes(417 - len(head)) if key % 2 else frame
    return b"ID3\4\0\0\0\0\0\0" + first + frame * (9 + key)


def page(granule: int, *packets: bytes) -> bytes:
    laces = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
    return b"OggS\0\0" + struct.pack("<q", granule) + bytes(12) + bytes([len(laces)]) + laces + b"".join(packets)


def speech(key: int, name: str) -> bytes:
    """An Opus file of key + 1 seconds with a title."""
    head = b"OpusHead\1" + bytes([1 + key % 2]) + struct.pack("<HI", 312, 16_000) + bytes(3)
    entry = f"TITLE={name}".encode()
    tags = b"OpusTags" + struct.pack("<I", 7) + b"refract" + struct.pack("<II", 1, len(entry)) + entry
    return page(0, head) + page(0, tags) + page(48_000 * (key + 1) + 312, b"sound")


def element(name: str, data: bytes) -> bytes:
    return bytes.fromhex(name) + struct.pack(">I", len(data) | 0x10000000) + data


def clip(key: int, name: str) -> bytes:
    """A Matroska file of a VP9 and an Opus track, key + 1.5 seconds long."""
    picture = element("AE", element("83", b"\1") + element("86", b"V_VP9") + element("23E383", struct.pack(">I", 40_000_000)) + element("E0", element("B0", struct.pack(">H", 320 + key)) + element("BA", struct.pack(">H", 240 + key))))
    voice = element("AE", element("83", b"\2") + element("86", b"A_OPUS") + element("22B59C", b"eng") + element("E1", element("B5", struct.pack(">d", 48000.0)) + element("9F", bytes([1 + key % 2]))))
    info = element("4489", struct.pack(">f", 1000.0 * key + 1500)) + element("7BA9", name.encode()) + element("2AD7B1", struct.pack(">I", 1_000_000))
    return element("1A45DFA3", element("4282", b"webm")) + element("18538067", element("1549A966", info) + element("1654AE6B", picture + voice) + element("1F43B675", bytes(99)))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def picture(key: int, name: str) -> bytes:
    """A PNG with a packed comment, a prompt and a time."""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 10 + key, 20 + key, 8, 2, 0, 0, 0)) + chunk(b"tIME", struct.pack(">HBBBBB", 2020, 1 + key % 12, 2, 3, 4, 5)) + chunk(
        b"iTXt", b"Software\0\1\0en\0\0" + zlib.compress(name.encode())
    ) + chunk(b"tEXt", b"parameters\0" + f"Steps: {key}".encode()) + chunk(b"IEND", b"")


def photo(key: int, name: str) -> bytes:
    """A JPEG with a press record."""
    entry = lambda n, text: struct.pack(">BBBH", 28, 2, n, len(text)) + text
    record = entry(5, name.encode()) + entry(25, b"key") + entry(25, str(key).encode())
    data = b"Photoshop 3.0\0" + b"8BIM\4\4\0\0" + struct.pack(">I", len(record)) + record
    return b"\xff\xd8\xff\xed" + struct.pack(">H", len(data) + 2) + data + b"\xff\xd9"


def document(key: int, name: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("docProps/core.xml", f"<p><dc:title>{name} &amp; co</dc:title><cp:revision>{key}</cp:revision></p>")
        z.writestr("docProps/app.xml", f"<p><Application>Writer</Application><AppVersion>{key}.0</AppVersion></p>")
        z.writestr("word/document.xml", "<w/>")
        for i in range(key % 3):
            z.writestr(f"word/media/image{i}.png", b"x")
    return out.getvalue()


MAKERS = {"mp4": film, "mp3": lambda key, _: sound(key), "ogg": speech, "webm": clip, "png": picture, "jpeg": photo, "zip": document}


def made(spark, d, kind: str):
    """Boxes of one file of a kind for each nation."""

    def make(batches):
        for part in batches:
            rows = [(f"{k}.{kind}", kind, MAKERS[kind](int(k), n)) for k, n in zip(part.n_nationkey, part.n_name)]
            yield pd.DataFrame(rows, columns=["path", "format", "content"])

    return boxes(table(spark, d, "nation").select("n_nationkey", "n_name").mapInPandas(make, "path string, format string, content binary"))


@query("""SELECT n_nationkey || '.mp4' AS path, CAST(0 AS INT) AS track, 'video' AS kind, 'h264' AS codec, 640 + 16 * n_nationkey AS width, 360 + 8 * n_nationkey AS height, CAST(NULL AS BIGINT) AS channels, CAST(NULL AS BIGINT) AS sample_rate, CAST(NULL AS BIGINT) AS bits, (2000 + 100 * n_nationkey) / 1000.0::DOUBLE AS duration FROM nation
UNION ALL SELECT n_nationkey || '.mp4', 1, 'audio', 'aac', NULL, NULL, 1 + n_nationkey % 2, CASE n_nationkey % 3 WHEN 0 THEN 48000 WHEN 1 THEN 44100 ELSE 32000 END, 16, 4.0 FROM nation""")
def film_tracks(spark, d):
    return streams.mp4_streams(made(spark, d, "mp4"))


@query("""SELECT n_nationkey || '.mp4' AS path, t.key, CASE t.key WHEN 'title' THEN n_name WHEN 'encoder' THEN 'refract' ELSE 'maker ' || n_nationkey END AS value FROM nation, (VALUES ('title'), ('encoder'), ('Make')) AS t(key)""")
def film_tags(spark, d):
    b = made(spark, d, "mp4")
    return media.tags(b).unionByName(media.dotted_tags(b)).select("path", "key", "value")


@query("""SELECT n_nationkey || '.mp3' AS path, 'mp3' AS codec, '1' AS version, CAST(3 AS BIGINT) AS layer, CAST(2 AS BIGINT) AS channels, CAST(44100 AS BIGINT) AS sample_rate,
CAST(CASE WHEN n_nationkey % 2 = 1 THEN floor(417 * (10 + n_nationkey) * 8.0 / ((1000 + n_nationkey) * 1152 / 44100.0::DOUBLE) + 0.5) ELSE 128000 END AS BIGINT) AS bitrate, n_nationkey % 2 = 1 AS vbr,
CASE WHEN n_nationkey % 2 = 1 THEN (1000 + n_nationkey) * 1152 / 44100.0::DOUBLE ELSE 417 * (10 + n_nationkey) * 8 / 128000.0::DOUBLE END AS duration FROM nation""")
def sound_streams(spark, d):
    return streams.mpeg_streams(made(spark, d, "mp3"))


@query("""SELECT n_nationkey || '.ogg' AS path, 'opus' AS codec, CAST(1 + n_nationkey % 2 AS BIGINT) AS channels, CAST(16000 AS BIGINT) AS sample_rate, CAST(n_nationkey + 1 AS DOUBLE) AS duration, n_name AS title FROM nation""")
def speech_streams(spark, d):
    b = made(spark, d, "ogg")
    titles = media.tags(b).where("key = 'title'").select("path", F.col("value").alias("title"))
    return streams.ogg_streams(b).join(titles, "path", "left")


@query("""SELECT n_nationkey || '.webm' AS path, CAST(0 AS INT) AS track, 'video' AS kind, 'vp9' AS codec, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS language, 320 + n_nationkey AS width, 240 + n_nationkey AS height, 25.0::DOUBLE AS frame_rate, CAST(NULL AS BIGINT) AS channels, CAST(NULL AS BIGINT) AS sample_rate, CAST(NULL AS BIGINT) AS bits FROM nation
UNION ALL SELECT n_nationkey || '.webm', 1, 'audio', 'opus', NULL, 'eng', NULL, NULL, NULL, 1 + n_nationkey % 2, 48000, NULL FROM nation""")
def clip_tracks(spark, d):
    return streams.matroska_streams(made(spark, d, "webm"))


@query("""SELECT n_nationkey || '.webm' AS path, 'webm' AS doctype, n_name AS title, n_nationkey + 1.5::DOUBLE AS duration FROM nation""")
def clip_facts(spark, d):
    return streams.matroska_movies(made(spark, d, "webm")).select("path", "doctype", "title", "duration")


@query("""SELECT n_nationkey || '.png' AS path, t.key, CASE t.key WHEN 'Software' THEN n_name WHEN 'ai_prompt' THEN 'Steps: ' || n_nationkey ELSE '2020-' || lpad(CAST(1 + n_nationkey % 12 AS VARCHAR), 2, '0') || '-02T03:04:05Z' END AS value FROM nation, (VALUES ('Software'), ('ai_prompt'), ('modification_time')) AS t(key)""")
def picture_tags(spark, d):
    return media.tags(made(spark, d, "png")).select("path", "key", "value")


@query("""SELECT n_nationkey || '.jpeg' AS path, t.key, CASE t.key WHEN 'IPTC Title' THEN n_name ELSE 'key, ' || n_nationkey END AS value FROM nation, (VALUES ('IPTC Title'), ('IPTC Keywords')) AS t(key)""")
def press_tags(spark, d):
    return media.iptc_tags(made(spark, d, "jpeg"))


@query("""SELECT n_nationkey || '.zip' AS path, 'docx' AS kind, true AS is_document, CAST(4 + n_nationkey % 3 AS BIGINT) AS n_files, CAST(n_nationkey % 3 AS BIGINT) AS n_media FROM nation""")
def document_kinds(spark, d):
    return streams.archives(made(spark, d, "zip"))


@query("""SELECT n_nationkey || '.zip' AS path, t.key, CASE t.key WHEN 'Title' THEN n_name || ' & co' WHEN 'Revision' THEN CAST(n_nationkey AS VARCHAR) WHEN 'Application' THEN 'Writer' WHEN 'AppVersion' THEN n_nationkey || '.0' ELSE 'Writer ' || n_nationkey || '.0' END AS value
FROM nation, (VALUES ('Title'), ('Revision'), ('Application'), ('AppVersion'), ('Software')) AS t(key)""")
def document_properties(spark, d):
    return streams.document_tags(made(spark, d, "zip"))
