"""Odd files: long payloads, damaged packets, empty tables, histories."""

from __future__ import annotations

import struct
import zlib

from refract.operators import media, streams
from refract.plans.files import box, chunk, page, sound
from refract.sources.containers import HEAD_BYTES, boxes, mpeg_header

LONG = b"x" * 700_000


def test_whole_payloads_and_heads(spark):
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"tEXt", b"long\0" + LONG) + chunk(b"zTXt", b"packed\0\0" + zlib.compress(LONG)) + chunk(b"iTXt", b"bad\0\1\0\0\0no zlib") + chunk(b"IDAT", LONG)
    entries = [(0x9000 + i, 3, 1, struct.pack("<HH", i, 0)) for i in range(700)]
    tiff = b"II*\0\x08\0\0\0" + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHI", t, k, n) + v for t, k, n, v in entries) + bytes(4)
    exif = b"\x89PNG\r\n\x1a\n" + chunk(b"eXIf", tiff)
    comment = b"OpusTags" + struct.pack("<I", 0) + struct.pack("<II", 2, 100_006) + b"TITLE=" + b"y" * 100_000 + struct.pack("<I", 9) + b"short"
    ogg = page(0, b"OpusHead\1\2" + bytes(9)) + b"".join(page(0, comment[i : i + 255 * 200]) for i in range(0, len(comment), 255 * 200))
    rows = [("a", "png", png), ("b", "png", exif), ("c", "ogg", ogg), ("d", "mp4", box(b"mdat", LONG)), ("e", "png", None), ("f", "mp3", b"")]
    b = boxes(spark.createDataFrame([(p, k, None if c is None else bytearray(c)) for p, k, c in rows], "path string, format string, content binary")).cache()
    tags = {(r.path, r.key): r.value for r in media.tags(b).collect()}
    assert len(tags["a", "long"]) == len(tags["a", "packed"]) == len(LONG) and ("a", "bad") not in tags
    assert b.where("path = 'b' AND box LIKE 'exif.%'").count() == 700
    parts = {(r.path, r.box): (r.size, len(r.payload), r.whole) for r in b.where("NOT whole").collect()}
    assert parts == {("a", "IDAT"): (len(LONG) + 12, HEAD_BYTES, False), ("a", "iTXt"): (27, 4, False), ("d", "mdat"): (len(LONG) + 8, HEAD_BYTES, False)}
    assert b.where("path IN ('e', 'f')").count() == 0


def test_frames_and_empty_tables(spark):
    assert mpeg_header(b"\xff\xfb\x90\x00", 0)["length"] == 417 and mpeg_header(b"\xff\xff\xff\xff", 0) is None
    noise = b"\xff\xfb\x90\x00 one header only"
    files = spark.createDataFrame([("n", "mp3", bytearray(noise)), ("s", "mp3", bytearray(b"junk" + sound(0)))], "path string, format string, content binary")
    assert [(r.path, r.codec, r.bitrate) for r in streams.mpeg_streams(boxes(files)).collect()] == [("s", "mp3", 128_000)]
    none = boxes(files.limit(0))
    for f in (streams.mp4_streams, streams.mpeg_streams, streams.ogg_streams, streams.matroska_streams, streams.matroska_movies, streams.archives, streams.document_tags, streams.archive_head, streams.box_texts, media.iptc_tags, media.dotted_tags):
        assert f(none).count() == 0


def test_xmp_history(spark):
    xmp = """<rdf:Seq><rdf:li stEvt:action="created" stEvt:softwareAgent="Editor 1" stEvt:when="2020-01-01"/>
<rdf:li rdf:parseType="Resource"><stEvt:action>saved</stEvt:action><stEvt:softwareAgent>Editor 2</stEvt:softwareAgent></rdf:li></rdf:Seq>"""
    rows = spark.createDataFrame([("a", 1, "xmp", xmp), ("b", 1, "xmp", None), ("c", 1, "title", "x")], "path string, ordinal int, key string, value string")
    got = [(r.path, r.place, r.action, r.agent, r.at) for r in media.xmp_history(rows).orderBy("place").collect()]
    assert got == [("a", 0, "created", "Editor 1", "2020-01-01"), ("a", 1, "saved", "Editor 2", None)]
