"""Container files as rows of boxes: one Python stage walks the bytes, everything after is DataFrame work.

A walker only finds where boxes lie; it yields (name, offset of the box, its size, payload).  Fields are cut
out of payloads with column expressions (see operators.media).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .pdf import pdf

#: Boxes of pixels, samples and pictures, of which only a head travels; every other payload is whole.
BULK = frozenset(("data", "IDAT", "fdAT", "mdat", "VP8 ", "VP8L", "ALPH", "ANMF", "PICTURE", "APIC", "moov.udta.meta.ilst.covr.data"))
HEAD_BYTES = 4096
#: Bytes that a compressed text may grow to before it counts as a bomb; its row then isn't ``whole``.
INFLATE_BYTES = 256 * 1024 * 1024

BOXES = "path string, format string, ordinal int, box string, offset bigint, size bigint, payload binary, parse_error string, whole boolean"

Box = tuple[str, int, int, bytes]


class Head(bytes):
    """Bytes whose rest stays in the file."""


def cut(name: str, b: bytes, lo: int, hi: int) -> bytes:
    """The payload of a box between two offsets."""
    if name in BULK and min(hi, len(b)) - lo > HEAD_BYTES:
        return Head(b[lo : lo + HEAD_BYTES])
    return b[lo:hi]


def riff(b: bytes) -> Iterator[Box]:
    at = 12
    while at + 8 <= len(b):
        size = int.from_bytes(b[at + 4 : at + 8], "little")
        name = b[at : at + 4].decode("latin-1")
        data = cut(name, b, at + 8, at + 8 + size)
        yield name, at, size + 8, data
        if name == "EXIF":
            yield from exif(data.removeprefix(b"Exif\0\0"), at + 8)
        if name == "LIST" and b[at + 8 : at + 12] == b"INFO":
            inner = at + 12
            while inner + 8 <= min(len(b), at + 8 + size):
                n = int.from_bytes(b[inner + 4 : inner + 8], "little")
                yield "INFO." + b[inner : inner + 4].decode("latin-1"), inner, n + 8, b[inner + 8 : inner + 8 + n]
                inner += 8 + n + n % 2
        at += 8 + size + size % 2


# Marks of the character sets of a user comment, with the encodings that they are found to mean.
CHARSETS = {b"ASCII": ("ascii", "utf-8", "latin-1"), b"UNICODE": ("utf-16-be", "utf-16-le", "utf-8"), b"JIS": ("iso2022_jp", "shift_jis", "euc_jp"), b"": ("utf-8", "utf-16-be", "utf-16-le", "latin-1")}


def _doubt(text: str) -> tuple[bool, float]:
    """How little a text reads like a comment: whether it has controls or undecodable characters, and then how few of its
    characters are printable ASCII (others that are printable count half)."""
    bad = any(c == "\ufffd" or not (c.isprintable() or c in "\r\n\t") for c in text)
    return bad, -sum(1.0 if c <= "~" else 0.5 for c in text) / max(1, len(text))


def user_comment(raw: bytes, big_endian: bool) -> str:
    """Text of an EXIF user comment: of the encodings that its mark allows, the one that reads best; the file's byte order
    comes first where two read alike."""
    mark, body = raw[:8].rstrip(b"\0 "), raw[8:]
    names = CHARSETS.get(mark.upper(), CHARSETS[b""])
    if not big_endian:
        names = sorted(names, key=lambda n: n == "utf-16-be")
    found = []
    for i, name in enumerate(names):
        text = body[: len(body) - len(body) % 2 if name.startswith("utf-16") else None].decode(name, "replace").rstrip("\0")
        found.append((_doubt(text), i, text.replace("\0", "")))
    return min(found)[2].strip() if body else ""


#: Bytes before a TIFF block where no container says that there is one.
EXIF_MARK = b"Exif\0\0"


def exif_anywhere(b: bytes, base: int = 0, until: int | None = None) -> Iterator[Box]:
    """Entries of the first EXIF block that its mark and a directory with entries show, wherever it is (before ``until``)."""
    at = b.find(EXIF_MARK)
    while 0 <= at < (len(b) if until is None else until):
        found = []
        try:
            for row in exif(b[at + 6 :], base + at + 6):
                found.append(row)
        except (struct.error, IndexError):
            pass  # a directory that breaks off keeps what was read
        if found:
            yield from found
            return
        at = b.find(EXIF_MARK, at + 1)


def exif(b: bytes, base: int) -> Iterator[Box]:
    """Entries of the image, camera and place directories of a TIFF block, values as text.

    Names are ``exif.`` and the directory's pointer tag (0000 for the first) and the tag in hex; several
    numbers are joined by spaces, a fraction is written n/d.
    """
    order = {b"II": "<", b"MM": ">"}.get(b[:2])
    if not order or len(b) < 8 or struct.unpack_from(order + "H", b, 2)[0] != 42:
        return
    todo, seen = [(0, struct.unpack_from(order + "I", b, 4)[0])], set()
    while todo:
        directory, at = todo.pop(0)
        if at in seen or at + 2 > len(b):
            continue
        seen.add(at)
        for i in range(struct.unpack_from(order + "H", b, at)[0]):
            entry = at + 2 + 12 * i
            if entry + 12 > len(b):
                break
            tag, kind, n = struct.unpack_from(order + "HHI", b, entry)
            code = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I"}.get(kind)
            if not code:
                continue
            width = struct.calcsize("<" + code) * n
            place = entry + 8 if width <= 4 else struct.unpack_from(order + "I", b, entry + 8)[0]
            raw = b[place : place + width]
            if len(raw) < width:
                continue
            if (directory, tag) == (0x8769, 0x9286):
                text = user_comment(raw, order == ">").encode()
            elif code == "s":
                text = raw if kind == 7 else raw.split(b"\0")[0]
            else:
                numbers = [v for v in struct.iter_unpack(order + code, raw)]
                text = " ".join("/".join(map(str, v)) for v in numbers).encode()
            if tag in (0x8769, 0x8825) and text.isdigit():
                todo.append((tag, int(text)))
            else:
                yield f"exif.{directory:04X}.{tag:04X}", base + entry, 12, text


def png(b: bytes) -> Iterator[Box]:
    at = 8
    while at + 12 <= len(b):
        size = int.from_bytes(b[at : at + 4], "big")
        name = b[at + 4 : at + 8].decode("latin-1")
        data = cut(name, b, at + 8, at + 8 + size)
        if name in ("zTXt", "iTXt") and b"\0" in data:
            data = png_text(data, name == "iTXt")
        yield name, at, size + 12, data
        if name == "eXIf":
            yield from exif(data, at + 8)
        if name == "IEND":
            return
        at += size + 12


def png_text(data: bytes, international: bool) -> bytes:
    """Keyword, NUL and the text of a compressed or international chunk; the language and its keyword go."""
    key, _, rest = data.partition(b"\0")
    packed = True
    if international:
        packed, rest = rest[:1] == b"\1", b"\0" + rest[2:].split(b"\0", 2)[-1]
    text = inflate(rest[1:]) if packed else rest[1:]
    return type(text)(key + b"\0" + text)


def jpeg(b: bytes) -> Iterator[Box]:
    """Segments up to the start of scan."""
    at = 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        marker = b[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9 or marker == 0xDA:
            return
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        size = int.from_bytes(b[at + 2 : at + 4], "big")
        data = b[at + 4 : at + 2 + size]
        yield f"{marker:02X}", at, size + 2, data
        if marker == 0xE1 and data[:6] == b"Exif\0\0":
            yield from exif(data[6:], at + 10)
        if marker == 0xED and data[:14] == b"Photoshop 3.0\0":
            yield from iptc(data, at + 4)
        at += size + 2


def iptc(b: bytes, base: int) -> Iterator[Box]:
    """Data sets of the press record of a Photoshop segment, named ``iptc.record.number``."""
    at = 14
    while b[at : at + 4] == b"8BIM":
        # The name of a resource takes an even number of bytes with its length, its data too.
        size_at = at + 6 + (b[at + 6] + 2) // 2 * 2
        start = size_at + 4
        size = int.from_bytes(b[size_at:start], "big")
        if b[at + 4 : at + 6] == b"\4\4":
            entry = start
            while entry + 5 <= min(start + size, len(b)) and b[entry] == 0x1C:
                n = int.from_bytes(b[entry + 3 : entry + 5], "big")
                yield f"iptc.{b[entry + 1]}.{b[entry + 2]}", base + entry, 5 + n, b[entry + 5 : entry + 5 + n]
                entry += 5 + n
        at = start + size + size % 2


# Boxes that hold boxes.
BMFF_CONTAINERS = frozenset("moov trak mdia minf stbl udta ilst edts dinf mvex moof traf meta iprp ipco".split())


def bmff(b: bytes, lo: int = 0, hi: int | None = None, prefix: str = "", depth: int = 0) -> Iterator[Box]:
    hi = len(b) if hi is None else hi
    while lo + 8 <= hi:
        size, head = int.from_bytes(b[lo : lo + 4], "big"), 8
        kind = b[lo + 4 : lo + 8].decode("latin-1")
        if size == 1 and lo + 16 <= hi:
            size, head = int.from_bytes(b[lo + 8 : lo + 16], "big"), 16
        elif size == 0:
            size = hi - lo
        if size < head:
            return
        end = min(hi, lo + size)
        inner = (kind in BMFF_CONTAINERS or prefix.endswith("ilst.")) and depth < 12
        yield prefix + kind, lo, size, b"" if inner else cut(prefix + kind, b, lo + head, end)
        if kind == "ipma":
            yield from associations(b[lo + head : end], prefix + kind, lo)
        if inner:
            yield from bmff(b, lo + head + 4 * (kind == "meta"), end, prefix + kind + ".", depth + 1)
        lo += size


def associations(x: bytes, name: str, base: int) -> Iterator[Box]:
    """Items of a property association box, named by their ids: the numbers of their properties, two bytes each."""
    wide, long, at = x[0] > 0, x[3] & 1, 8
    for _ in range(int.from_bytes(x[4:8], "big")):
        item, at = int.from_bytes(x[at : at + 2 + 2 * wide], "big"), at + 2 + 2 * wide
        n, at = x[at], at + 1
        found = [int.from_bytes(x[at + i * (1 + long) : at + (i + 1) * (1 + long)], "big") & (0x7FFF if long else 0x7F) for i in range(n)]
        at += n * (1 + long)
        yield f"{name}.{item}", base, 0, b"".join(v.to_bytes(2, "big") for v in found)


def flac(b: bytes) -> Iterator[Box]:
    at, last = 4, False
    while not last and at + 4 <= len(b):
        last, kind, size = bool(b[at] & 0x80), b[at] & 0x7F, int.from_bytes(b[at + 1 : at + 4], "big")
        name = {0: "STREAMINFO", 4: "VORBIS_COMMENT", 6: "PICTURE"}.get(kind, f"BLOCK{kind}")
        yield name, at, size + 4, cut(name, b, at + 4, at + 4 + size)
        if kind == 4:
            yield from comments(b[at + 4 : at + 4 + size], at + 4)
        at += 4 + size


def comments(b: bytes, base: int) -> Iterator[Box]:
    """Entries of a Vorbis comment block, named ``comment.`` and the key in lower case."""
    if len(b) < 8:
        return
    at = 4 + int.from_bytes(b[:4], "little")
    left, at = int.from_bytes(b[at : at + 4], "little"), at + 4
    while left > 0 and at + 4 <= len(b):
        n = int.from_bytes(b[at : at + 4], "little")
        key, equals, value = b[at + 4 : at + 4 + n].partition(b"=")
        if key and equals:
            yield "comment." + key.decode("utf-8", "replace").lower(), base + at, 4 + n, value
        at, left = at + 4 + n, left - 1


def ogg(b: bytes) -> Iterator[Box]:
    """The first two packets, whatever pages they lie on, their comments and the last page's granule position."""
    at, start, packet, seen = 0, 0, b"", 0
    while b[at : at + 4] == b"OggS" and at + 27 <= len(b) and seen < 2:
        n = b[at + 26]
        body = at + 27 + n
        for lace in b[at + 27 : at + 27 + n]:
            packet += b[body : body + lace]
            body += lace
            if lace < 255 and seen < 2:
                yield ("ident", "comment")[seen], start, len(packet), packet
                mark = next((m for m in (b"OpusTags", b"\x03vorbis") if packet.startswith(m)), None)
                if seen and mark:
                    yield from comments(packet[len(mark) :], start)
                packet, start, seen = b"", body, seen + 1
        at = body
    last = b.rfind(b"OggS", max(0, len(b) - 131_072))
    if last >= 0 and last + 14 <= len(b):
        yield "last", last, len(b) - last, b[last + 6 : last + 14]


# kbit/s of MPEG audio by version and layer, samples a second by version bits.
MPEG_BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
MPEG_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def mpeg_header(b: bytes, at: int) -> dict | None:
    """What the four bytes of an MPEG audio frame say, with the frame's length."""
    word = int.from_bytes(b[at : at + 4], "big")
    version, layer, rate_at, speed = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 10 & 3, word >> 12 & 15
    if at + 4 > len(b) or word >> 21 != 0x7FF or version == 1 or layer == 4 or rate_at == 3 or speed in (0, 15):
        return None
    first = version == 3
    bitrate = 1000 * MPEG_BITRATES[2 - first, layer][speed - 1]
    rate, padding = MPEG_RATES[version][rate_at], word >> 9 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and not first else 1152
    length = (12 * bitrate // rate + padding) * 4 if layer == 1 else samples // 8 * bitrate // rate + padding
    return {"version": {3: "1", 2: "2", 0: "2.5"}[version], "layer": layer, "bitrate": bitrate, "sample_rate": rate, "channels": 1 if word >> 6 & 3 == 3 else 2, "samples": samples, "length": length, "crc": not word >> 16 & 1}


def mpeg(b: bytes, start: int) -> Iterator[Box]:
    """Facts of the first of two consecutive frames as ``frame.*`` texts; counts of a Xing or VBRI header where there is one."""
    at = b.find(b"\xff", start)
    while at >= 0:
        head = mpeg_header(b, at)
        after = mpeg_header(b, at + head["length"]) if head else None
        if after and (after["sample_rate"], after["layer"]) == (head["sample_rate"], head["layer"]):
            break
        at = b.find(b"\xff", at + 1)
    if at < 0:
        return
    mono = head["channels"] == 1
    side = (17 if mono else 32) if head["version"] == "1" else (9 if mono else 17)
    x = at + 4 + 2 * head["crc"] + side
    number = lambda i: int.from_bytes(b[i : i + 4], "big")
    facts = {k: head[k] for k in ("version", "layer", "bitrate", "sample_rate", "channels", "samples")}
    if b[x : x + 4] in (b"Xing", b"Info"):
        flags = number(x + 4)
        facts |= {"count": number(x + 8)} if flags & 1 else {}
        facts |= {"bytes": number(x + 8 + 4 * (flags & 1))} if flags & 2 else {}
        facts["vbr"] = int(b[x : x + 4] == b"Xing")
    elif b[at + 36 : at + 40] == b"VBRI":
        facts |= {"count": number(at + 50), "bytes": number(at + 46), "vbr": 1}
    end = len(b) - 128 * (b[-128:-125] == b"TAG")
    for key, value in facts.items():
        yield f"frame.{key}", at, end - at, str(value).encode()


def id3(b: bytes) -> Iterator[Box]:
    """Frames of an ID3v2 tag, then what the first audio frame says."""
    end = 0
    if b[:3] == b"ID3" and len(b) >= 10:
        synchsafe = lambda x: x[0] << 21 | x[1] << 14 | x[2] << 7 | x[3]
        end, at, version = 10 + synchsafe(b[6:10]), 10, b[3]
        yield "ID3", 0, end, b[:10]
        while at + 10 <= min(end, len(b)) and b[at] != 0:
            size = synchsafe(b[at + 4 : at + 8]) if version == 4 else int.from_bytes(b[at + 4 : at + 8], "big")
            name = b[at : at + 4].decode("latin-1")
            yield name, at, size + 10, cut(name, b, at + 10, at + 10 + size)
            at += 10 + size
    yield from mpeg(b, end)


def zip_entries(b: bytes) -> Iterator[Box]:
    """Entries of the central directory; document properties come with their text."""
    end = b.rfind(b"PK\5\6", max(0, len(b) - 65_557))
    if end < 0:
        return
    at = int.from_bytes(b[end + 16 : end + 20], "little")
    while b[at : at + 4] == b"PK\1\2" and at + 46 <= len(b):
        method, = struct.unpack_from("<H", b, at + 10)
        packed, size, n, extra, note = struct.unpack_from("<IIHHH", b, at + 20)
        local, = struct.unpack_from("<I", b, at + 42)
        name = b[at + 46 : at + 46 + n].decode("utf-8", "replace")
        data = b""
        if name.endswith((".xml", "mimetype")) and local + 30 <= len(b):
            a, c = struct.unpack_from("<HH", b, local + 26)
            raw = b[local + 30 + a + c : local + 30 + a + c + packed]
            data = inflate(raw, -15) if method == 8 else raw if method == 0 else b""
        yield name, local, size, data
        at += 46 + n + extra + note


def ebml(b: bytes, lo: int = 0, hi: int | None = None, prefix: str = "") -> Iterator[Box]:
    """Elements up to the first cluster; ids in hex."""
    hi = len(b) if hi is None else hi
    while lo < hi:
        n = 9 - b[lo].bit_length()
        if n > 4 or lo + n >= hi:
            return
        name = b[lo : lo + n].hex().upper()
        m = 9 - b[lo + n].bit_length()
        if m > 8 or lo + n + m > hi:
            return
        size = int.from_bytes(b[lo + n : lo + n + m], "big") - (1 << 7 * m)
        start = lo + n + m
        end = hi if size == (1 << 7 * m) - 1 else min(hi, start + size)
        if name == "1F43B675":
            return
        inner = name in ("1A45DFA3", "18538067", "1549A966", "1654AE6B", "AE", "E0", "E1")
        yield prefix + name, lo, end - lo, b"" if inner else b[start:end]
        if inner:
            yield from ebml(b, start, end, prefix + name + ".")
        lo = end


def whole(b: bytes) -> Iterator[Box]:
    yield "file", 0, len(b), b if len(b) <= HEAD_BYTES else Head(b[:HEAD_BYTES])


def inflate(data: bytes, bits: int = 15) -> bytes:
    """What a compressed text grows to; what was read of one that is damaged, cut or too large is a head."""
    z, out, left = zlib.decompressobj(bits), [], INFLATE_BYTES
    try:
        for at in range(0, len(data), 4096):
            out.append(z.decompress(data[at : at + 4096], left))
            left -= len(out[-1])
            if z.unconsumed_tail or left <= 0:
                return Head(b"".join(out))
    except zlib.error:
        return Head(b"".join(out))
    whole = b"".join(out) + z.flush()
    return whole if z.eof else Head(whole)


def tiff(b: bytes) -> Iterator[Box]:
    yield from whole(b)
    yield from exif(b, 0)


def pdf_file(b: bytes) -> Iterator[Box]:
    yield "file", 0, len(b), Head(b[:HEAD_BYTES])
    yield from pdf(b)


def walked(kind: str, b: bytes) -> Iterator[Box]:
    """The boxes of a file, and the EXIF entries that none of them told."""
    told = False
    for box in WALKERS.get(kind, whole)(b):
        told = told or box[0].startswith("exif.")
        yield box
    if not told and kind != "tiff":
        yield from exif_anywhere(b)


WALKERS = {"wav": riff, "webp": riff, "png": png, "jpeg": jpeg, "mp4": bmff, "heif": bmff, "flac": flac, "ogg": ogg, "mp3": id3, "zip": zip_entries, "webm": ebml, "pdf": pdf_file, "tiff": tiff}



def boxes(files: DataFrame) -> DataFrame:
    """path, format, ordinal, box, offset, size, payload, whole of every box; a file that breaks off keeps what was read.

    Payloads of boxes that hold boxes are empty; ``whole`` is false where only the head of a payload travels.
    files: path, format, content.  Null content has no boxes.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, kind, content in zip(*(batch.column(c).to_pylist() for c in ("path", "format", "content"))):
                rows, error = [], None
                try:
                    rows.extend((path, kind, i, *box, None, not isinstance(box[3], Head)) for i, box in enumerate(walked(kind, content or b"")) if content)
                except (IndexError, struct.error, ValueError) as e:
                    error = f"{type(e).__name__}: {e}"
                if error:
                    rows.append((path, kind, len(rows), "error", None, None, None, error, None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.bool_()))], BOX_NAMES)

    return files.select("path", "format", "content").mapInArrow(walk, BOXES)


BOX_NAMES = [c.split()[0] for c in BOXES.split(", ")]
