"""Provenance manifests as rows: the store of a file is located and its boxes are listed with their digests.

Python only walks bytes; references, digests and verdicts are compared by joins (operators.provenance).
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .containers import jpeg, png

# Fixed value: the UUID of manifest boxes in ISO media files.
MANIFEST_UUID = bytes.fromhex("d8fec3d61b0e483c92975828877ec481")

# Boxes of ISO media files that hold boxes; meta has four bytes before them.
HOLDERS = frozenset("moov trak mdia minf stbl edts dinf udta moof traf mfra mvex sinf schi meta".split())

NO_STORE = "no manifest store"
ROWS = "path string, container string, manifests int, manifest int, manifest_label string, box string, label string, start bigint, end bigint, body_sha256 string, whole_sha256 string, content string, error string"


def _boxes(b: bytes, lo: int, hi: int) -> Iterator[tuple[str, int, int, int]]:
    """(type, start, start of the body, end) of sibling boxes."""
    while lo + 8 <= hi:
        size, head = struct.unpack_from(">I", b, lo)[0], 8
        if size == 1 and lo + 16 <= hi:
            size, head = struct.unpack_from(">Q", b, lo + 8)[0], 16
        size = size or hi - lo
        if size < head or lo + size > hi:
            return
        yield b[lo + 4 : lo + 8].decode("latin-1"), lo, lo + head, lo + size
        lo += size


def _from_jpeg(b: bytes) -> bytes | None:
    parts: dict[int, list[tuple[int, bytes]]] = {}
    for marker, _, _, data in jpeg(b):
        if marker == "EB" and data[:2] == b"JP":
            number, place = struct.unpack_from(">HI", data, 2)
            parts.setdefault(number, []).append((place, data[8:]))
    for found in parts.values():
        found.sort(key=lambda x: x[0])
        if found[0][1][4:8] == b"jumb":
            # Later segments repeat the header of the box.
            return found[0][1] + b"".join(data[8:] for _, data in found[1:])
    return None


def _from_bmff(b: bytes) -> bytes | None:
    for kind, _, body, end in _boxes(b, 0, len(b)):
        if kind == "uuid" and b[body : body + 16] == MANIFEST_UUID:
            purpose, _, rest = b[body + 20 : end].partition(b"\0")
            if purpose == b"manifest":
                return rest[8:]
    return None


def _anywhere(b: bytes) -> bytes | None:
    at = b.find(b"jumb", 4)
    while at >= 0:
        size = int.from_bytes(b[at - 4 : at], "big")
        if b[at + 8 : at + 16] == b"jumdc2pa" and 32 < size <= len(b) - at + 4:
            return b[at - 4 : at - 4 + size]
        at = b.find(b"jumb", at + 1)
    return None


def locate(b: bytes) -> tuple[bytes, str] | None:
    """The manifest store and the kind of place it was found in."""
    if b[:2] == b"\xff\xd8" and (found := _from_jpeg(b)):
        return found, "jpeg"
    if b[:4] == b"\x89PNG":
        found = next((data for name, _, _, data in png(b) if name == "caBX"), None)
        if found:
            return found, "png"
    if b[4:8] == b"ftyp" and (found := _from_bmff(b)):
        return found, "bmff"
    found = _anywhere(b)
    return (found, "embedded") if found else None


_STOP = object()


def cbor(b: bytes, at: int = 0, depth: int = 0):
    """(value, next offset): byte strings become lower-case hex, tags their value."""
    if depth > 64:
        raise ValueError("nested too deeply")
    major, info = b[at] >> 5, b[at] & 31
    at += 1
    if major == 7:
        if info in (25, 26, 27):
            n = 1 << info - 24
            return struct.unpack_from({2: ">e", 4: ">f", 8: ">d"}[n], b, at)[0], at + n
        return {20: False, 21: True, 31: _STOP}.get(info), at + (info == 24)
    n, endless = info, info == 31
    if 24 <= info <= 27:
        width = 1 << info - 24
        n, at = int.from_bytes(b[at : at + width], "big"), at + width
    elif 28 <= info < 31:
        raise ValueError("reserved length")
    if major < 2:
        return (n if major == 0 else -1 - n), at
    if major in (2, 3) and not endless:
        if at + n > len(b):
            raise ValueError("string ends early")
        return (b[at : at + n].hex() if major == 2 else b[at : at + n].decode("utf-8", "replace")), at + n
    if major == 6:
        return cbor(b, at, depth + 1)
    items = []
    left = -1 if endless else n * (2 if major == 5 else 1)
    while left:
        value, at = cbor(b, at, depth + 1)
        if value is _STOP:
            break
        items.append(value)
        left -= 1
    if major in (2, 3):
        return "".join(items), at
    return (items if major == 4 else {str(k): v for k, v in zip(items[::2], items[1::2])}), at


def _content(store: bytes, body: int, end: int) -> str | None:
    """JSON text of the first CBOR or JSON box inside."""
    for kind, _, lo, hi in _boxes(store, body, end):
        if kind == "cbor":
            return json.dumps(cbor(store[lo:hi])[0])
        if kind == "json":
            return store[lo:hi].decode("utf-8", "replace")
    return None


def _label(store: bytes, body: int, end: int) -> str:
    for kind, _, lo, hi in _boxes(store, body, end):
        if kind == "jumd":
            return store[lo + 17 : hi].partition(b"\0")[0].decode("latin-1")
    return ""


class Part(NamedTuple):
    """An assertion, claim or signature: where its box starts, its body and end, and the value that it holds."""

    start: int
    body: int
    end: int
    value: object


class Manifest(NamedTuple):
    number: int
    label: str
    start: int
    body: int
    end: int
    claim: object
    assertions: dict[str, Part]
    parts: dict[str, Part]


def _value(store: bytes, body: int, end: int):
    text = _content(store, body, end)
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


def opened(b: bytes) -> tuple[str, bytes, list[Manifest], str | None] | None:
    """(container, store, manifests, error) of a file's store; None without one.

    A damaged manifest ends the list and is told by the error.
    """
    found = locate(b)
    if not found:
        return None
    store, container = found
    inner = lambda lo, hi: [(_label(store, x, y), s, x, y) for kind, s, x, y in _boxes(store, lo, hi) if kind == "jumb"]
    root = next((r for r in inner(0, len(store)) if r[0] == "c2pa"), None)
    if root is None:
        return container, store, [], NO_STORE
    out: list[Manifest] = []
    for i, (name, start, body, end) in enumerate(inner(*root[2:])):
        try:
            parts = {label: Part(s, x, y, _value(store, x, y) if label.startswith("c2pa.claim") else None) for label, s, x, y in inner(body, end)}
            at = parts.get("c2pa.assertions")
            assertions = {label: Part(s, x, y, _value(store, x, y)) for label, s, x, y in inner(at.body, at.end)} if at else {}
        except (ValueError, IndexError, struct.error, TypeError, KeyError) as e:
            return container, store, out, f"{type(e).__name__}: {e}"
        claim = parts.get("c2pa.claim") or parts.get("c2pa.claim.v2")
        out.append(Manifest(i, name, start, body, end, claim.value if claim else None, assertions, parts))
    return container, store, out, None


def _rows(path: str, b: bytes) -> Iterator[tuple]:
    found = locate(b)
    if not found:
        return
    store, container = found
    digest = lambda lo, hi: hashlib.sha256(store[lo:hi]).hexdigest()
    inner = lambda lo, hi: [(_label(store, x, y), s, x, y) for kind, s, x, y in _boxes(store, lo, hi) if kind == "jumb"]
    roots = [r for r in inner(0, len(store)) if r[0] == "c2pa"]
    if not roots:
        yield path, container, 0, None, None, "error", None, None, None, None, None, None, NO_STORE
        return
    manifests = inner(roots[0][2], roots[0][3])
    for i, (name, start, body, end) in enumerate(manifests):
        yield path, container, len(manifests), i, name, "manifest", name, start, end, digest(body, end), digest(start, end), None, None
        for label, s, x, y in inner(body, end):
            kind = {"c2pa.claim": "claim", "c2pa.claim.v2": "claim", "c2pa.signature": "signature"}.get(label)
            if kind:
                yield path, container, len(manifests), i, name, kind, label, s, y, digest(x, y), digest(s, y), _content(store, x, y), None
            elif label == "c2pa.assertions":
                for leaf, s2, x2, y2 in inner(x, y):
                    yield path, container, len(manifests), i, name, "assertion", leaf, s2, y2, digest(x2, y2), digest(s2, y2), _content(store, x2, y2), None


_KINDS = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]


def manifest_boxes(files: DataFrame) -> DataFrame:
    """Rows of manifests, claims, signatures and assertions of files (path, content) that have a store.

    A damaged store keeps the rows that could be read and adds one of box ``error``.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    for row in _rows(path, content or b""):
                        out.append(row)
                except (ValueError, IndexError, struct.error, TypeError, KeyError) as e:
                    out.append((path, None, None, None, None, "error", None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], [c.split()[0] for c in ROWS.split(", ")])

    return files.select("path", "content").mapInArrow(walk, ROWS)


def places(b: bytes, lo: int = 0, hi: int | None = None, above: str = "", depth: int = 0) -> Iterator[tuple[str, int, int, int, bool]]:
    """Path, place, size and header length of every box of an ISO media file, and whether it is in no other."""
    for kind, start, body, end in _boxes(b, lo, len(b) if hi is None else hi):
        yield f"{above}/{kind}", start, end - start, body - start, not depth
        if depth < 8 and kind in HOLDERS:
            yield from places(b, body + 4 * (kind == "meta"), end, f"{above}/{kind}", depth + 1)
