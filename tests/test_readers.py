"""PDF structure, picture items, EXIF that nobody points to, and comments in unknown character sets."""

from __future__ import annotations

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from refract.operators import media
from refract.plans import provenance as P
from refract.sources.containers import Head, boxes, exif_anywhere, inflate, user_comment
from refract.sources.pdf import hexadecimal, literal, pdf, text


@pytest.mark.parametrize(
    "raw, want",
    [
        (b"(plain)", "plain"), (b"(a (nested (deep)) b)", "a (nested (deep)) b"), (rb"(\(\) \\ \n\t|)", "() \\ \n\t|"), (rb"(\101\7\0534\53)", "A\x07+4+"), (b"(line \\\r\ngoes \\\non)", "line goes on"), (rb"(\q)", "q"),
        (b"(\xfe\xff\0a\x20\xac)", "a€"), (b"(\xef\xbb\xbf\xc3\xa9)", "é"), (b"(\xe9)", "é"), (b"<FEFF00410042>", "AB"), (b"<4 1\n4>", "A@"), (b"<>", ""),
    ],
)
def test_strings(raw, want):
    data, end = literal(raw, 0) if raw[:1] == b"(" else hexadecimal(raw, 0)
    assert end == len(raw) and (text(data) == want or text(data) == want.strip())


def test_open_strings():
    assert literal(b"(never closed \\) (x)", 0) is None and hexadecimal(b"<41 no hex>", 0) is None and hexadecimal(b"<41", 0) is None


def kinds(b):
    return [name for name, *_ in pdf(b)]


def test_chains_of_sections():
    b = P.saved_paper(3, "N")
    assert kinds(b).count("xref") == 4 and kinds(b).count("info.Title") == 4 and kinds(b)[-1] == "xmp"
    lost = b[: b.rindex(b"startxref")] + b"startxref\n7\n%%EOF"
    assert "xref.lost" in kinds(lost) and "xref" not in kinds(lost)
    loop = b"%PDF-1.4\nxref\ntrailer << /Prev 9 >>\nstartxref\n9\n%%EOF"
    assert kinds(loop).count("xref") == 1
    stream = b"%PDF-1.5\n7 0 obj << /Type /XRef /Length 3 >> stream\nabc endstream\nstartxref\n9\n%%EOF"
    assert kinds(stream) == ["header", "xref"] and kinds(b"") == [] and kinds(b"%PDF-1.4 cut") == ["header"]
    assert kinds(b"%PDF-1.4 /Title << /S >> /Author (a") == ["header"]


def test_updates_of_a_linearized_file(spark):
    first = b"%PDF-1.5\n<< /Linearized 1 >>\n"
    at = len(first)
    first += b"xref\ntrailer << >>\nstartxref\n0\n%%EOF\n"
    second = first + b"xref\ntrailer << /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, len(first))
    rows = [("lin", "pdf", bytearray(second)), ("empty", "pdf", bytearray(b"")), ("null", "pdf", None), ("other", "generic", bytearray(b"x"))]
    got = {r.path: r for r in media.pdf_info(boxes(spark.createDataFrame(rows, "path string, format string, content binary"))).collect()}
    assert set(got) == {"lin"} and (got["lin"].revisions, got["lin"].updates, got["lin"].Title) == (2, 0, None)


@pytest.mark.parametrize("big", [True, False])
@pytest.mark.parametrize(
    "mark, name, words",
    [
        (b"ASCII\0\0\0", "ascii", "plain words"), (b"UNICODE\0", "utf-16-be", "both orders"), (b"UNICODE\0", "utf-16-le", "both orders"), (b"UNICODE\0", "utf-16-le", "mixed é 東 text"), (b"JIS\0\0\0\0\0", "iso2022_jp", "東京タワー"),
        (b"JIS\0\0\0\0\0", "shift_jis", "東京タワー abc"), (bytes(8), "utf-8", "unmarked é"), (bytes(8), "latin-1", "caf\xe9 au lait"), (b"ASCII\0\0\0", "utf-8", "not quite ascii é"), (bytes(8), "ascii", ""),
    ],
)
def test_charset_vote(mark, name, words, big):
    assert user_comment(mark + words.encode(name), big) == words


def test_exif_over_borders_and_decoys():
    block = P.hidden(7, "Maker").partition(b"Exif\0\0MM")[2]
    block = b"Exif\0\0MM" + block
    for before in (0, 1, (4 << 20) - 3, (4 << 20) + 100_000):
        b = b"Exif\0\0II*\0" + b"\xff" * 6 + bytes(before) + block
        found = dict((name, data) for name, _, _, data in exif_anywhere(b))
        assert found["exif.0000.010F"] == b"Maker"
    assert list(exif_anywhere(b"Exif\0\0" * 50)) == [] and list(exif_anywhere(b"")) == []
    assert list(exif_anywhere(bytes(100) + block, until=50)) == []


def test_exif_number_kinds():
    fields = [(0x9201, 10, struct.pack("<ii", -7, 3)), (0xA301, 6, b"\xfe"), (0x9202, 8, struct.pack("<h", -5)), (0x9203, 11, struct.pack("<f", 0.5)), (0x9206, 12, struct.pack("<d", 0.25))]
    heap_at, rows, heap = 8 + 2 + 12 * len(fields) + 4, b"", b""
    for tag, kind, data in fields:
        place = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", heap_at + len(heap))
        heap += data if len(data) > 4 else b""
        rows += struct.pack("<HHI", tag, kind, 1) + place
    b = b"Exif\0\0II*\0" + struct.pack("<IH", 8, len(fields)) + rows + bytes(4) + heap
    assert [data for *_, data in exif_anywhere(b)] == [b"-7/3", b"-2", b"-5", b"0.5", b"0.25"]


def test_damaged_texts_are_heads():
    packed = zlib.compress(bytes(range(256)) * 400)
    assert inflate(packed) == bytes(range(256)) * 400 and not isinstance(inflate(packed), Head)
    for bad in (packed[:-20], packed[:200] + b"\xff\xff\xff\xff" + packed[204:], b"nothing"):
        out = inflate(bad)
        assert isinstance(out, Head) and (bytes(range(256)) * 400).startswith(bytes(out)[:150])


def test_pictures_without_sizes(spark):
    rows = [(f"{k}", "heif", bytearray(P.still(k, "n"))) for k in (0, 1)] + [("none", "heif", bytearray(P.box(b"ftyp", b"heic") + P.box(b"meta", bytes(4)))), ("null", "heif", None), ("tiff", "tiff", bytearray(b"II*\0\xff\xff\xff\xff"))]
    b = boxes(spark.createDataFrame(rows, "path string, format string, content binary"))
    assert {r.path: (r.width, r.height) for r in media.heif_pictures(b).collect()} == {"0": (1000, 700), "1": (1001, 701)}
    assert media.tiff_pictures(b).count() == 0 and b.where(F.col("path") == "tiff").count() == 1
