"""Manifests made in the test, and what each change to a file does to its checks."""

from __future__ import annotations

import hashlib
import struct

import pytest

from refract.operators import provenance as P
from refract.queries import QUERIES
from refract.sources.binding import box_digest, data_digest
from refract.sources.manifests import cbor, locate, manifest_boxes
from refract.sources.walk import walk


def encode(v) -> bytes:
    def head(major, n):
        return bytes([major << 5 | n]) if n < 24 else bytes([major << 5 | 24, n]) if n < 256 else bytes([major << 5 | 25]) + struct.pack(">H", n) if n < 65536 else bytes([major << 5 | 26]) + struct.pack(">I", n)

    if v is None or isinstance(v, bool):
        return {None: b"\xf6", True: b"\xf5", False: b"\xf4"}[v]
    if isinstance(v, int):
        return head(0, v) if v >= 0 else head(1, -1 - v)
    if isinstance(v, bytes):
        return head(2, len(v)) + v
    if isinstance(v, str):
        return head(3, len(v.encode())) + v.encode()
    if isinstance(v, list):
        return head(4, len(v)) + b"".join(map(encode, v))
    return head(5, len(v)) + b"".join(encode(k) + encode(x) for k, x in v.items())


def box(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data) + 8) + kind + data


def jumb(label: str, *inner: bytes, kind: bytes = b"cbor") -> bytes:
    return box(b"jumb", box(b"jumd", kind + bytes(12) + b"\3" + label.encode() + b"\0") + b"".join(inner))


def manifest(name: str, assertions: dict, **claim) -> bytes:
    made = {k: jumb(k, box(b"cbor", encode(v))) for k, v in assertions.items()}
    refs = [{"url": f"self#jumbf=c2pa.assertions/{k}", "hash": hashlib.sha256(b[8:]).digest()} for k, b in made.items()]
    body = {"claim_generator": "maker/1", "alg": "sha256", "assertions": refs, **claim}
    return jumb(name, jumb("c2pa.assertions", *made.values()), jumb("c2pa.claim", box(b"cbor", encode(body))), jumb("c2pa.signature", box(b"cbor", encode([b"", {}, None, b"sig"]))))


ACTIONS = {"actions": [{"action": "c2pa.created", "softwareAgent": "Painter", "digitalSourceType": "http://x/trainedAlgorithmicMedia"}]}


def signed(body: bytes = b"pixels " * 40, earlier: bytes | None = None) -> bytes:
    """A file with its store in the middle; the data hash leaves the store out."""
    front, back = b"HEAD" + body, body + b"TAIL"

    def store(length):
        data = {"exclusions": [{"start": len(front), "length": length}], "hash": hashlib.sha256(front + back).digest(), "alg": "sha256"}
        assertions = {"c2pa.hash.data": data, "c2pa.actions": ACTIONS}
        if earlier:
            assertions["c2pa.ingredient"] = {"c2pa_manifest": {"url": "self#jumbf=/c2pa/urn:old", "hash": hashlib.sha256(earlier[8:]).digest()}}
        return jumb("c2pa", *([earlier] if earlier else []), manifest("urn:new", assertions), kind=b"c2pa")

    length = 60_000
    while len(store(length)) != length:
        length = len(store(length))
    return front + store(length) + back


def changed(b: bytes, at: int) -> bytes:
    return b[:at] + bytes([b[at] ^ 1]) + b[at + 1 :]


OLD = manifest("urn:old", {"c2pa.actions": {"actions": []}})
GOOD, WITH_HISTORY = signed(), signed(earlier=OLD)
CASES = {
    "good": (GOOD, "partial"), "pixel": (changed(GOOD, 10), "invalid"), "tail": (changed(GOOD, len(GOOD) - 2), "invalid"),
    "assertion": (changed(GOOD, GOOD.index(b"Painter")), "invalid"), "missing": (GOOD.replace(b"assertions/c2pa.actions", b"assertions/c2pa.aktions"), "invalid"),
    "history": (WITH_HISTORY, "partial"), "history changed": (changed(WITH_HISTORY, WITH_HISTORY.index(b"maker/1")), "invalid"),
    "no claim": (GOOD.replace(b"c2pa.claim\0", b"c2pa.klaim\0"), "unreadable"),
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(n, bytearray(b)) for n, (b, _) in CASES.items()] + [("plain", bytearray(b"nothing here")), ("empty", bytearray(b"")), ("null", None)]
    return spark.createDataFrame(rows, "path string, content binary").repartition(3).cache()


def test_tamper_matrix(files):
    got = {r.path: r.status for r in P.status(walk(files)).collect()}
    assert got == {n: s for n, (_, s) in CASES.items()}


def test_counts_and_actions(files):
    b = manifest_boxes(files).where("path = 'history'")
    row = P.status(walk(files.where("path = 'history'"))).first()
    assert (row.held, row.failed, row.unchecked) == (6, 0, 1)
    a = P.actions(b).first()
    assert (a.action, a.agent, a.source, a.ai) == ("c2pa.created", "Painter", "trainedAlgorithmicMedia", True)
    lost = P.assertion_checks(walk(files).where("path = 'missing'")).where("NOT ok").first()
    assert lost.label == "c2pa.aktions"


def test_places_of_a_store():
    store = jumb("c2pa", manifest("urn:m", {"c2pa.actions": ACTIONS}), kind=b"c2pa")
    chunk = struct.pack(">I", len(store)) + b"caBX" + store + bytes(4)
    assert locate(b"\x89PNG\r\n\x1a\n" + chunk) == (store, "png")
    half = len(store) // 2
    segment = lambda n, data: b"\xff\xeb" + struct.pack(">H", len(data) + 10) + b"JP" + struct.pack(">HI", 1, n) + data
    assert locate(b"\xff\xd8" + segment(2, store[:8] + store[half:]) + segment(1, store[:half]) + b"\xff\xd9") == (store, "jpeg")
    uuid = bytes.fromhex("d8fec3d61b0e483c92975828877ec481")
    assert locate(box(b"ftyp", b"isom") + box(b"uuid", uuid + bytes(4) + b"manifest\0" + bytes(8) + store)) == (store, "bmff")
    assert locate(b"%PDF " + store) == (store, "embedded") and locate(b"%PDF") is None


def test_cbor_forms():
    assert cbor(encode({"a": [1, -5, 300, 70000, None, True, b"\x01\xff", "é"]}))[0] == {"a": [1, -5, 300, 70000, None, True, "01ff", "é"]}
    assert cbor(bytes.fromhex("bf6161f93c00ff"))[0] == {"a": 1.0}
    assert cbor(bytes.fromhex("7f61616162ff"))[0] == "ab" and cbor(bytes.fromhex("d2820102"))[0] == [1, 2]


def test_overlapping_spans():
    ranges = [{"start": s, "length": n} for s, n in ((8, 1), (2, 3), (4, 2))]
    assert data_digest(b"abcdefghij", {"exclusions": ranges}) == hashlib.sha256(b"abghj").hexdigest()
    assert data_digest(b"abc", {"exclusions": [{"start": 0, "length": 9}], "alg": "sha512"}) == hashlib.sha512().hexdigest()
    assert data_digest(b"abc", {"alg": "md5"}) is None


def test_boxes_that_are_left_out():
    """By path, length, version, flags, what a box holds, and parts of it; offsets of what stays are marked."""
    a, b, c = box(b"aaaa", b"\1\0\0\5 left"), box(b"bbbb", b"12345678"), box(b"cccc", b"xyz")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    one = lambda e, marked=False: box_digest(a + b + c, {"exclusions": [e]}, marked)
    at = lambda n: struct.pack(">Q", n)
    assert one({"xpath": "/aaaa"}) == sha(b + c) == one({"xpath": "/aaaa", "version": 1, "flags": "000005", "length": len(a)})
    assert one({"xpath": "/aaaa", "version": 2}) == one({"xpath": "/aaaa", "length": 3}) == one({"xpath": "/aaaa", "flags": "000004"}) == sha(a + b + c)
    assert one({"xpath": "/aaaa", "flags": "000007", "exact": False}) == sha(b + c)
    assert one({"xpath": "/bbbb", "data": [{"offset": 8, "value": "3132"}]}) == sha(a + c) != one({"xpath": "/bbbb", "data": [{"offset": 8, "value": "3133"}]})
    assert one({"xpath": "/bbbb", "subset": [{"offset": 10, "length": 2}, {"offset": 14, "length": 0}]}) == sha(a + b[:10] + b[12:14] + c)
    assert one({"xpath": "/bbbb"}, True) == sha(at(0) + a + at(len(a + b)) + c)
    assert box_digest(a, {"merkle": [1]}, True) is None


def test_checks_scan_their_files_once(spark):
    """However many checks there are, the plan reads the files and walks them once."""
    for name in ("provenance_verdict", "provenance_checks", "provenance_history", "film_binding", "ai_credentials", "ai_verdict"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1 and plan.count("MapInArrow") == (name != "ai_verdict"), (name, plan)
