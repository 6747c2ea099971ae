"""Queries over signed files that are built from table rows: a small authority signs one file a nation, some are damaged."""

from __future__ import annotations

import functools
import hashlib
import struct

import pandas as pd
from pyspark.sql import functions as F

from ..operators import ai_origin, media, provenance, report, signatures
from ..registry import query, table
from ..sources.certificates import to_be_signed
from ..sources.containers import boxes
from ..sources.manifests import MANIFEST_UUID, manifest_boxes
from ..sources.walk import walk
from .files import box, picture

RSA, SHA256_RSA = "2a864886f70d010101", "2a864886f70d01010b"
SHA256_INFO = bytes.fromhex("3031300d060960864801650304020105000420")


def _prime(seed: str) -> int:
    n = int.from_bytes(hashlib.sha512(seed.encode()).digest(), "big") | 3 << 510 | 1
    while n % 65537 == 1 or any(pow(a, n - 1, n) != 1 for a in (2, 3, 5)):
        n += 2
    return n


class Signer:
    """An RSA key that follows from its name."""

    def __init__(self, name: str):
        p, q = _prime(name + " p"), _prime(name + " q")
        self.n, self.d = p * q, pow(65537, -1, (p - 1) * (q - 1))

    def power(self, block: bytes) -> bytes:
        return pow(int.from_bytes(block, "big"), self.d, self.n).to_bytes(128, "big")

    def pkcs1(self, message: bytes) -> bytes:
        info = SHA256_INFO + hashlib.sha256(message).digest()
        return self.power(b"\0\1" + b"\xff" * (125 - len(info)) + b"\0" + info)

    def pss(self, message: bytes) -> bytes:
        salt = hashlib.sha256(b"salt" + message).digest()
        h = hashlib.sha256(bytes(8) + hashlib.sha256(message).digest() + salt).digest()
        mask = b"".join(hashlib.sha256(h + struct.pack(">I", i)).digest() for i in range(3))[:95]
        block = bytearray(x ^ y for x, y in zip(bytes(62) + b"\1" + salt, mask))
        block[0] &= 0x7F
        return self.power(bytes(block) + h + b"\xbc")

    def public(self) -> bytes:
        number = lambda v: tlv(2, v.to_bytes(v.bit_length() // 8 + 1, "big"))
        return tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex(RSA)), tlv(5)), tlv(3, b"\0", tlv(0x30, number(self.n), number(65537))))


signer = functools.lru_cache(Signer)


def tlv(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + body


def certificate(subject: str, key: Signer, issuer: str, by: Signer, until: str = "20900101000000Z") -> bytes:
    alg = tlv(0x30, tlv(6, bytes.fromhex(SHA256_RSA)), tlv(5))
    name = lambda n: tlv(0x30, *(tlv(0x31, tlv(0x30, tlv(6, b"\x55\4" + oid), tlv(12, v.encode()))) for oid, v in ((b"\3", n), (b"\x0a", "Org"))))
    body = tlv(0x30, tlv(0xA0, tlv(2, b"\2")), tlv(2, b"\1"), alg, name(issuer), tlv(0x30, tlv(0x17, b"200101000000Z"), tlv(0x18, until.encode())), name(subject), key.public())
    return tlv(0x30, body, alg, tlv(3, b"\0", by.pkcs1(body)))


def encode(v) -> bytes:
    """CBOR of what manifests hold."""

    def head(major: int, n: int) -> bytes:
        return bytes([major << 5 | n]) if n < 24 else bytes([major << 5 | 25]) + struct.pack(">H", n)

    if isinstance(v, dict):
        return head(5, len(v)) + b"".join(encode(k) + encode(x) for k, x in v.items())
    if isinstance(v, list):
        return head(4, len(v)) + b"".join(map(encode, v))
    if isinstance(v, int):
        return head(0, v) if v >= 0 else head(1, -1 - v)
    return b"\xf6" if v is None else head(2, len(v)) + v if isinstance(v, bytes) else head(3, len(v.encode())) + v.encode()


def jumb(label: str, *inner: bytes, kind: bytes = b"cbor") -> bytes:
    return box(b"jumb", box(b"jumd", kind + bytes(12) + b"\3" + label.encode() + b"\0"), *inner)


def manifest(name: str, assertions: dict, leaf: Signer, chain: list[bytes]) -> bytes:
    """A manifest, its claim signed by ``leaf``."""
    made = {k: jumb(k, box(b"cbor", encode(v))) for k, v in assertions.items()}
    refs = [{"url": f"self#jumbf=c2pa.assertions/{k}", "hash": hashlib.sha256(b[8:]).digest()} for k, b in made.items()]
    claim = encode({"claim_generator": "maker/1", "alg": "sha256", "assertions": refs})
    protected = encode({1: -37, 33: chain})
    signature = encode([protected, {}, None, leaf.pss(to_be_signed(protected, claim))])
    return jumb(name, jumb("c2pa.assertions", *made.values()), jumb("c2pa.claim", box(b"cbor", claim)), jumb("c2pa.signature", box(b"cbor", signature)))


def store(assertions: dict, leaf: Signer, chain: list[bytes], *earlier: bytes) -> bytes:
    """A manifest store, earlier manifests first."""
    return jumb("c2pa", *earlier, manifest("urn:new", assertions, leaf, chain), kind=b"c2pa")


def settled(make) -> bytes:
    """What ``make`` gives for its own length."""
    n = 3000
    while len(made := make(n)) != n:
        n = len(made)
    return made


def actions(name: str) -> dict:
    return {"actions": [{"action": "c2pa.created", "softwareAgent": f"Painter of {name}", "digitalSourceType": "http://x/trainedAlgorithmicMedia"}, {"action": "c2pa.edited", "softwareAgent": name}]}


def signed_picture(key: int, name: str) -> bytes:
    """By key: valid, a byte changed, an unknown root, a certificate that ended, no certificate, no credentials."""
    case, front, back = key % 6, picture(key, name)[:-12], picture(key, name)[-12:]
    root, leaf = signer("other" if case == 2 else "root"), signer("leaf")
    until = "20210101000000Z" if case == 3 else "20900101000000Z"
    chain = [] if case == 4 else [certificate(name, leaf, "other" if case == 2 else "root", root, until)]
    whole = hashlib.sha256(front + back).digest()
    chunk = settled(
        lambda n: (lambda s: struct.pack(">I", len(s)) + b"caBX" + s + bytes(4))(
            store({"c2pa.hash.data": {"exclusions": [{"start": len(front), "length": n}], "hash": whole, "alg": "sha256"}, "c2pa.actions": actions(name)}, leaf, chain)
        )
    )
    b = front + (b"" if case == 5 else chunk) + back
    return b[:20] + bytes([b[20] ^ 1]) + b[21:] if case == 1 else b


def signed_film(key: int, name: str) -> bytes:
    """By key: valid, its picture data changed, a box moved in front of them (the offsets are signed too), fragments."""
    case, head, movie, data = key % 4, box(b"ftyp", b"isom\0\0\2\0isom"), box(b"moov", box(b"mvhd", bytes(4) + name.encode())), box(b"mdat", bytes(100 + key))
    skipped = [{"xpath": "/uuid", "data": [{"offset": 8, "value": MANIFEST_UUID}]}, {"xpath": "/ftyp"}, {"xpath": "/free", "length": 999}, {"xpath": "/moov/mvhd", "version": 0, "flags": bytes(3), "subset": [{"offset": 12, "length": 2}]}]

    def uuid(n: int) -> bytes:
        at = lambda v: struct.pack(">Q", v)
        covered = at(len(head) + n) + movie[:20] + movie[22:] + at(len(head) + n + len(movie)) + data
        bound = {"exclusions": skipped, "hash": hashlib.sha384(covered).digest(), "alg": "sha384", **({"merkle": [1]} if case == 3 else {})}
        return box(b"uuid", MANIFEST_UUID + bytes(4) + b"manifest\0" + bytes(8) + store({"c2pa.hash.bmff.v2": bound, "c2pa.actions": actions(name)}, signer("leaf"), []))

    made = settled(uuid)
    return head + made + (box(b"free") if case == 2 else b"") + movie + (data[:-1] + b"\1" if case == 1 else data)


def signed_versions(key: int, name: str) -> bytes:
    """A picture signed three times.  By key: all of it good, the middle signature another's, the oldest changed after it."""
    case, front, back, leaf = key % 3, picture(key, name)[:-12], picture(key, name)[-12:], signer("leaf")
    by = lambda n: [certificate(f"{name} {n}", leaf, "root", signer("root"))]
    of = lambda m, n: {"c2pa.ingredient": {"c2pa_manifest": {"url": f"self#jumbf=/c2pa/urn:{n}", "hash": hashlib.sha256(m[8:]).digest()}}}
    first = manifest("urn:1", {"c2pa.actions": actions(name)}, leaf, by(1))
    second = manifest("urn:2", {"c2pa.actions": actions(name), **of(first, 1)}, signer("other") if case == 1 else leaf, by(2))
    first = first.replace(b"c2pa.edited", b"c2pa.edit3d") if case == 2 else first
    bound = lambda n: {"c2pa.hash.data": {"exclusions": [{"start": len(front), "length": n}], "hash": hashlib.sha256(front + back).digest(), "alg": "sha256"}}
    chunk = settled(lambda n: (lambda s: struct.pack(">I", len(s)) + b"caBX" + s + bytes(4))(store({**bound(n), **of(second, 2)}, leaf, by(3), first, second)))
    return front + chunk + back


def entry(tag: int, kind: int, n: int, value: bytes) -> bytes:
    return struct.pack("<HHI", tag, kind, n) + value.ljust(4, b"\0")


def photo(key: int, name: str) -> bytes:
    """A JPEG with camera, exposure and place, edited in a program that XMP tells of."""
    word, short = (lambda v: struct.pack("<I", v)), (lambda v: struct.pack("<H", v))
    data = name.encode() + b"\0"
    maker, camera = 8 + 2 + 12 * 3 + 4, 8 + 2 + 12 * 3 + 4 + len(data)
    place = camera + 2 + 12 * 2 + 4 + 16
    first = short(3) + entry(0x010F, 2, len(data), word(maker)) + entry(0x8769, 4, 1, word(camera)) + entry(0x8825, 4, 1, word(place)) + word(0) + data
    lens = camera + 2 + 12 * 2 + 4
    second = short(2) + entry(0x829A, 5, 1, word(lens)) + entry(0x829D, 5, 1, word(lens + 8)) + word(0) + struct.pack("<4I", 1, 10 + key, 28, 10)
    at = place + 2 + 12 * 4 + 4
    third = short(4) + entry(1, 2, 2, b"S\0" if key % 2 else b"N\0") + entry(2, 5, 3, word(at)) + entry(3, 2, 2, b"E\0") + entry(4, 5, 3, word(at + 24)) + word(0) + struct.pack("<12I", key, 1, 30, 1, 0, 1, 2 * key, 1, 15, 1, 0, 1)
    exif = b"Exif\0\0II*\0" + word(8) + first + second + third
    steps = "".join(f'<rdf:li stEvt:action="{a}" stEvt:softwareAgent="{name}" stEvt:when="2020-01-0{i}T00:00:00Z"/>' for i, a in ((1, "created"), (2, "saved")))
    xmp = b"http://ns.adobe.com/xap/1.0/\0" + f'<x tiff:Model="M{key}"><xmp:CreatorTool>{name} 1.0</xmp:CreatorTool>{steps}</x>'.encode()
    segment = lambda m, d: b"\xff" + m + struct.pack(">H", len(d) + 2) + d
    return b"\xff\xd8" + segment(b"\xe1", exif) + segment(b"\xe1", xmp) + segment(b"\xc0", struct.pack(">BHHB", 8, 100 + key, 200 + key, 3) + bytes(9)) + b"\xff\xd9"


def lossless(key: int, name: str) -> bytes:
    """A FLAC file of key + 1 seconds."""
    rate = 44_100
    packed = rate << 44 | (key % 2) << 41 | 15 << 36 | rate * (key + 1)
    note = f"ARTIST={name}".encode()
    notes = struct.pack("<I", 1) + b"r" + struct.pack("<II", 1, len(note)) + note
    head = lambda kind, d: bytes([kind]) + len(d).to_bytes(3, "big") + d
    return b"fLaC" + head(0, bytes(10) + packed.to_bytes(8, "big") + bytes(16)) + head(0x84, notes)


def paper(key: int, name: str) -> bytes:
    return f"%PDF-1.{key % 8}\n/Title (Old)\n/Title ({name} \\({key}\\))\n/Producer <{(chr(0xFEFF) + name).encode('utf-16-be').hex()}>\n".encode()


def saved_paper(key: int, name: str) -> bytes:
    """A PDF saved again key % 4 times: each save appends an information dictionary, a table and a trailer that points back.

    By key its title is written in octal escapes, in UTF-8 or in UTF-16 digits; the text after it is a decoy.
    """
    b, prev = b"%PDF-1.6\n", None
    for i in range(key % 4 + 1):
        title = f"{name} \u00e9 {i}"
        how = (key + i) % 3
        octal = "".join(f"\\{v:03o}" for v in title.encode("latin-1"))
        told = f"({octal})".encode() if how == 0 else b"(\xef\xbb\xbf" + title.encode() + b")" if how == 1 else f"<{(chr(0xFEFF) + title).encode('utf-16-be').hex()}>".encode()
        b += b"1 0 obj\n<< /Title " + told + b" /Creator (a\\\nb \\(c (d)) >>\nendobj\n"
        at = len(b)
        b += b"xref\n0 1\n0000000000 65535 f \ntrailer\n<< /Size 2 /Info 1 0 R " + (b"/Prev %d " % prev if prev else b"") + b">>\nstartxref\n%d\n%%%%EOF\n" % at
        prev = at
    xmp = f'<x:xmpmeta><rdf:Description xmp:CreatorTool="{name} tool"/></x:xmpmeta>'.encode() if key % 2 else b""
    return b + xmp


def still(key: int, name: str) -> bytes:
    """A HEIF file whose primary item is the second one; the first is its thumbnail, the third a tile of a grid."""
    size = lambda w, h: box(b"ispe", struct.pack(">III", 0, w, h))
    pitm = box(b"pitm", struct.pack(">IH", 0, 2)) if key % 2 else box(b"pitm", struct.pack(">II", 1 << 24, 2))
    props = box(b"ipco", size(160, 120), box(b"pixi", bytes(8)), size(512, 512), size(1000 + key, 700 + key))
    entry = lambda item, *p: struct.pack(">HB", item, len(p)) + bytes(p)
    tied = box(b"ipma", struct.pack(">II", 0, 3), entry(1, 1, 2), entry(2, 0x82, 4), entry(3, 3))
    return box(b"ftyp", b"heic\0\0\0\0mif1") + box(b"meta", bytes(4), pitm, box(b"iprp", props, tied)) + box(b"mdat", bytes(50), b"Exif\0\0 no block here ", name.encode())


def hidden(key: int, name: str) -> bytes:
    """A file of no known format with two decoys before an EXIF block whose comment is in a character set by key."""
    mark, coded = [(b"ASCII\0\0\0", "ascii"), (b"UNICODE\0", "utf-16-be"), (b"UNICODE\0", "utf-16-le"), (b"JIS\0\0\0\0\0", "iso2022_jp"), (bytes(8), "utf-8")][key % 5]
    text = f"{name} \u6771\u4eac" if key % 5 > 2 else f"{name} note"
    comment = mark + text.encode(coded)
    short, word = (lambda v: struct.pack(">H", v)), (lambda v: struct.pack(">I", v))
    field = lambda tag, kind, n, v: struct.pack(">HHI", tag, kind, n) + v.ljust(4, b"\0")
    maker = name.encode() + b"\0"
    at = 8 + 2 + 2 * 12 + 4
    first = short(2) + field(0x010F, 2, len(maker), word(at)) + field(0x8769, 4, 1, word(at + len(maker))) + word(0) + maker
    second = short(2) + field(0x9204, 10, 1, word(at + len(maker) + 2 + 24 + 4)) + field(0x9286, 7, len(comment), word(at + len(maker) + 2 + 24 + 4 + 8)) + word(0) + struct.pack(">ii", key - 12, 3) + comment
    block = b"Exif\0\0MM\0*" + word(8) + first + second
    return b"\1\2" + bytes(37 * key) + b"Exif\0\0II" + b"Exif\0\0II*\0\xff\xff\xff\x7f" + bytes(key) + block + bytes(9)


def scan(key: int, name: str) -> bytes:
    """A TIFF file that says its size and maker."""
    order, c = (b"II", "<") if key % 2 else (b"MM", ">")
    maker = name.encode() + b"\0"
    field = lambda tag, kind, n, v: struct.pack(c + "HHI", tag, kind, n) + v.ljust(4, b"\0")
    rows = field(0x0100, 3, 1, struct.pack(c + "H", 300 + key)) + field(0x0101, 4, 1, struct.pack(c + "I", 200 + key)) + field(0x010F, 2, len(maker), struct.pack(c + "I", 50))
    return order + struct.pack(c + "HIH", 42, 8, 3) + rows + struct.pack(c + "I", 0) + maker


def files(spark, d, kind: str, make):
    """path, format, content of one file a nation."""

    def rows(batches):
        for part in batches:
            yield pd.DataFrame([(f"{k}.{kind}", kind, make(int(k), n)) for k, n in zip(part.n_nationkey, part.n_name)], columns=["path", "format", "content"])

    return table(spark, d, "nation").select("n_nationkey", "n_name").mapInPandas(rows, "path string, format string, content binary")


def anchors(spark):
    root = signer("root")
    return spark.createDataFrame([(bytearray(certificate("root", root, "root", root)),)], "der binary")


_ISSUER = "CASE WHEN k = 4 THEN NULL WHEN k = 2 THEN 'other · Org' ELSE 'root · Org' END"


@query(f"""SELECT path, status, signer, organization, issuer, trusted_by, CASE status WHEN 'valid' THEN 'Verified: signed by ' || signer || ', and the file has not changed since.'
WHEN 'valid_untrusted' THEN 'Signature is valid and the file is unchanged, but "' || signer || '" is not on the official C2PA trust list.'
WHEN 'invalid' THEN 'FAILED: the credentials do not match this file. It was changed after signing, or the credentials are forged or copied.' ELSE 'Content Credentials are present but could not be read.' END AS headline
FROM (SELECT n_nationkey || '.png' AS path, CASE k WHEN 0 THEN 'valid' WHEN 2 THEN 'valid_untrusted' WHEN 4 THEN 'unreadable' ELSE 'invalid' END AS status, CASE WHEN k <> 4 THEN n_name END AS signer, CASE WHEN k <> 4 THEN 'Org' END AS organization,
{_ISSUER} AS issuer, CASE WHEN k IN (0, 1, 3) THEN 'root · Org' END AS trusted_by FROM (SELECT *, n_nationkey % 6 AS k FROM nation) n WHERE k < 5) v""")
def provenance_verdict(spark, d):
    f = files(spark, d, "png", signed_picture)
    return signatures.verdict(walk(f), anchors(spark), F.lit("2026-01-01T00:00:00Z")).drop("signed_at")


@query("""SELECT n_nationkey || '.png' AS path, c.name AS "check", CASE WHEN c.name = 'content' THEN n_nationkey % 6 <> 1 ELSE true END AS ok FROM nation, (VALUES ('c2pa.hash.data'), ('c2pa.actions'), ('content'), ('signature')) AS c(name)
WHERE n_nationkey % 6 < 4 OR (n_nationkey % 6 = 4 AND c.name <> 'signature')""")
def provenance_checks(spark, d):
    found = signatures.checks(walk(files(spark, d, "png", signed_picture))).where("kind IN ('assertion', 'content', 'signature')")
    return found.select("path", F.when(F.col("kind") == "assertion", F.col("label")).otherwise(F.col("kind")).alias("check"), "ok")


@query("""SELECT n_nationkey || '.png' AS path, a.action, CASE WHEN a.ai THEN 'Painter of ' || n_name ELSE n_name END AS agent, CASE WHEN a.ai THEN 'trainedAlgorithmicMedia' END AS source, a.ai FROM nation, (VALUES ('c2pa.created', true), ('c2pa.edited', false)) AS a(action, ai) WHERE n_nationkey % 6 < 5""")
def provenance_actions(spark, d):
    return provenance.actions(manifest_boxes(files(spark, d, "png", signed_picture))).drop("when")


@query("""SELECT n_nationkey || '.mp4' AS path, CASE n_nationkey % 4 WHEN 0 THEN true WHEN 3 THEN NULL ELSE false END AS ok FROM nation""")
def film_binding(spark, d):
    f = files(spark, d, "mp4", signed_film)
    return provenance.content_checks(walk(f))


@query("""SELECT n_nationkey || '.png' AS path, k < 5 AS is_ai, CASE WHEN k < 5 THEN 'confirmed' ELSE 'none' END AS confidence, CASE WHEN k < 5 THEN 'AI-generated' ELSE 'No AI marks found' END AS label,
CASE WHEN k IN (0, 2) THEN 'strong' WHEN k < 5 THEN 'medium' END AS strength, CASE WHEN k < 4 THEN 'Painter of ' || n_name END AS tool, CASE WHEN k < 4 THEN 'Org' END AS vendor, CASE k WHEN 0 THEN 'created by AI (Painter of ' || n_name || ') [verified]' WHEN 2 THEN 'created by AI (Painter of ' || n_name || ') [signature valid, signer not on the trust list]'
WHEN 4 THEN 'not verified their text says AI-made' WHEN 5 THEN NULL ELSE 'created by AI (Painter of ' || n_name || ') [FAILED verification]' END AS detail FROM (SELECT *, n_nationkey % 6 AS k FROM nation) n""")
def ai_credentials(spark, d):
    """The AI verdict where credentials are weighed by what their verification gave; the files are read once."""
    f = files(spark, d, "png", signed_picture).withColumn("raw", ai_origin.raw_text(F.col("content")))
    v = signatures.verdict(walk(f, keep=("raw",), every=True), anchors(spark), F.lit("2026-01-01T00:00:00Z"), raw=F.col("raw"), said=signatures.said())
    none = F.array().cast("array<struct<ordinal:int,key:string,value:string>>")
    told = ai_origin.judged(v.select("path", "raw", none.alias("tags"), signatures.credentials().alias("credentials")))
    weighed = F.get(F.filter("evidence", lambda e: e["source"] == "Content Credentials"), 0)
    return told.select("path", "is_ai", "confidence", "label", "tool", "vendor", weighed["strength"].alias("strength"), weighed["detail"].alias("detail"))


@query("""SELECT n_nationkey || '.png' AS path, m.i AS manifest, m.label, 2 - m.i AS depth, n_name || ' ' || (m.i + 1) AS signer, NOT (m.i = 1 AND n_nationkey % 3 = 1) AS signed, NOT (m.i = 0 AND n_nationkey % 3 = 2) AS intact,
CASE WHEN n_nationkey % 3 = 0 THEN 'valid' ELSE 'invalid' END AS status FROM nation, (VALUES (0, 'urn:1'), (1, 'urn:2'), (2, 'urn:new')) AS m(i, label)""")
def provenance_history(spark, d):
    """The versions of a file, oldest first, and the verdict that they lead to."""
    walked = walk(files(spark, d, "png", signed_versions))
    kept = signatures.verdict(walked, anchors(spark), F.lit("2026-01-01T00:00:00Z"), versions=signatures.versions())
    return kept.select("path", F.explode("versions").alias("m"), "status").select("path", "m.*", "status")


@query("""SELECT n_nationkey || '.jpeg' AS path, t.key, CASE t.key WHEN 'Make' THEN n_name WHEN 'ExposureTime' THEN '1/' || (10 + n_nationkey) || ' s' ELSE 'f/2.8' END AS value FROM nation, (VALUES ('Make'), ('ExposureTime'), ('FNumber')) AS t(key)""")
def photo_exif(spark, d):
    return media.exif_tags(boxes(files(spark, d, "jpeg", photo))).select("path", "key", "value")


@query("""SELECT n_nationkey || '.jpeg' AS path, (n_nationkey + 0.5::DOUBLE) * CASE n_nationkey % 2 WHEN 1 THEN -1 ELSE 1 END AS latitude, 2 * n_nationkey + 0.25::DOUBLE AS longitude, 100 + n_nationkey AS height, 200 + n_nationkey AS width FROM nation""")
def photo_places(spark, d):
    b = boxes(files(spark, d, "jpeg", photo))
    return media.exif_places(b).drop("altitude").join(media.pictures(b), "path")


@query("""SELECT n_nationkey || '.jpeg' AS path, CAST(h.place AS INT) AS place, h.action, n_name AS agent, h.moment AS at, 'M' || n_nationkey AS model, n_name || ' 1.0' AS tool FROM nation, (VALUES (0, 'created', '2020-01-01T00:00:00Z'), (1, 'saved', '2020-01-02T00:00:00Z')) AS h(place, action, moment)""")
def photo_history(spark, d):
    t = media.tags(boxes(files(spark, d, "jpeg", photo)))
    one = lambda k, n: F.max(F.when(F.col("key") == k, F.col("value"))).alias(n)
    return media.xmp_history(t).drop("ordinal").join(media.xmp_tags(t).groupBy("path").agg(one("Model", "model"), one("CreatorTool", "tool")), "path")


@query("""SELECT n_nationkey || '.flac' AS path, 'flac' AS codec, 1 + n_nationkey % 2 AS channels, 44100 AS sample_rate, 16 AS bits, CAST(n_nationkey + 1 AS DOUBLE) AS duration, n_name AS artist FROM nation""")
def lossless_streams(spark, d):
    b = boxes(files(spark, d, "flac", lossless))
    return media.flac_streams(b).join(media.tags(b).where("key = 'artist'").select("path", F.col("value").alias("artist")), "path", "left")


@query("""SELECT n_nationkey || '.pdf' AS path, '1.' || (n_nationkey % 8) AS version, n_name || ' (' || n_nationkey || ')' AS title, n_name AS producer FROM nation""")
def paper_info(spark, d):
    return media.pdf_info(boxes(files(spark, d, "pdf", paper))).select("path", "version", F.col("Title").alias("title"), F.col("Producer").alias("producer"))


@query("""SELECT n_nationkey || '.pdf' AS path, n_name || ' é ' || (n_nationkey % 4) AS title, 'ab (c (d)' AS creator, CAST(n_nationkey % 4 + 1 AS INT) AS revisions, CAST(n_nationkey % 4 AS INT) AS updates, false AS lost, CASE WHEN n_nationkey % 2 = 1 THEN n_name || ' tool' END AS tool FROM nation""")
def paper_updates(spark, d):
    """Titles in three encodings, the updates that the chain of cross-reference sections tells, and the tool that XMP names."""
    b = boxes(files(spark, d, "pdf", saved_paper))
    xmp = media.xmp_tags(media.tags(b)).where("key = 'CreatorTool'").select("path", F.col("value").alias("tool"))
    return media.pdf_info(b).select("path", F.col("Title").alias("title"), F.col("Creator").alias("creator"), "revisions", "updates", "lost").join(xmp, "path", "left")


@query("""SELECT n_nationkey || '.heif' AS path, CAST(1000 + n_nationkey AS BIGINT) AS width, CAST(700 + n_nationkey AS BIGINT) AS height FROM nation""")
def still_sizes(spark, d):
    return media.heif_pictures(boxes(files(spark, d, "heif", still)))


@query("""SELECT n_nationkey || '.generic' AS path, t.key, CASE t.key WHEN 'Make' THEN n_name WHEN 'UserComment' THEN n_name || CASE WHEN n_nationkey % 5 > 2 THEN ' 東京' ELSE ' note' END
ELSE printf('%+.1f EV', (n_nationkey - 12) / 3.0) END AS value FROM nation, (VALUES ('Make'), ('UserComment'), ('ExposureBias')) AS t(key)""")
def hidden_exif(spark, d):
    """EXIF blocks in files that don't say where they are, with comments whose encoding is told by how they read."""
    return media.exif_tags(boxes(files(spark, d, "generic", hidden))).select("path", "key", "value")


@query("""SELECT n_nationkey || '.tiff' AS path, CAST(300 + n_nationkey AS BIGINT) AS width, CAST(200 + n_nationkey AS BIGINT) AS height, n_name AS make FROM nation""")
def scan_sizes(spark, d):
    b = boxes(files(spark, d, "tiff", scan))
    return media.tiff_pictures(b).join(media.exif_tags(b).where("key = 'Make'").select("path", F.col("value").alias("make")), "path")


@query("""SELECT n_nationkey || '.jpeg' AS path, CAST(r.i AS INT) AS place, r.title, r.state, CASE r.i WHEN 0 THEN 'This is an image (' || (200 + n_nationkey) || ' × ' || (100 + n_nationkey) || ' pixels).' WHEN 1 THEN 'No AI labels were found, which proves nothing: they are often removed.'
WHEN 2 THEN 'Made on ' || n_name || '.' ELSE 'No signs of editing were found.' END AS text FROM nation, (VALUES (0, 'What it is', 'info'), (1, 'Made by AI?', 'info'), (2, 'Where it came from', 'info'), (3, 'Has it been edited?', 'good')) AS r(i, title, state)""")
def photo_report(spark, d):
    """The composed report of photos; the size in bytes is left out of the first sentence."""
    rows = report.pictures_report(files(spark, d, "jpeg", photo), anchors(spark), F.lit("2026-01-01T00:00:00Z"))
    return rows.withColumn("text", F.regexp_replace("text", r" \([0-9.]+ K?B\)", ""))


@query("""SELECT n_nationkey || '.png' AS path, r.title, CASE r.title WHEN 'Made by AI?' THEN CASE WHEN k < 5 THEN 'ai' ELSE 'info' END WHEN 'Has it been edited?' THEN CASE WHEN k < 5 THEN 'info' ELSE 'good' END
ELSE CASE k WHEN 0 THEN 'good' WHEN 1 THEN 'bad' WHEN 3 THEN 'bad' ELSE 'warn' END END AS state FROM (SELECT *, n_nationkey % 6 AS k FROM nation) n, (VALUES ('Made by AI?'), ('Has it been edited?'), ('Content Credentials')) AS r(title) WHERE k < 5 OR r.title <> 'Content Credentials'""")
def signed_report(spark, d):
    """States of the report of signed pictures: credentials that hold, that failed, and none."""
    rows = report.pictures_report(files(spark, d, "png", signed_picture), anchors(spark), F.lit("2026-01-01T00:00:00Z"))
    return rows.where("title IN ('Made by AI?', 'Has it been edited?', 'Content Credentials')").select("path", "title", "state")
