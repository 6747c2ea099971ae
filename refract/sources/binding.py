"""What a signed digest of a file covers: the bytes outside of its exclusions, fed to one hash piece by piece."""

from __future__ import annotations

import hashlib

from .manifests import places

DIGESTS = ("sha256", "sha384", "sha512")


def new_hash(alg: str | None):
    """A hash by the name of its algorithm; None for others."""
    return hashlib.new(alg or "sha256") if (alg or "sha256") in DIGESTS else None


def data_digest(b: bytes, assertion: dict) -> str | None:
    """Digest of the bytes outside of ranges, which may touch or overlap."""
    h = new_hash(assertion.get("alg"))
    if h is None:
        return None
    at, view = 0, memoryview(b)
    for start, length in sorted((e["start"], e["length"]) for e in assertion.get("exclusions") or []):
        h.update(view[at : max(at, start)])
        at = max(at, start + length)
    h.update(view[at:])
    return h.hexdigest()


def _meant(b: bytes, p: tuple, e: dict) -> bool:
    """Whether an exclusion means a box: by path, length, version, flags and what the box holds."""
    xpath, start, size, head, _ = p
    if xpath != e.get("xpath") or e.get("length") not in (None, size):
        return False
    if e.get("version") is not None and b[start + head : start + head + 1] != bytes([e["version"]]):
        return False
    if len(e.get("flags") or "") >= 6:
        want, flags = int(e["flags"][:6], 16), int.from_bytes(b[start + head + 1 : start + head + 4], "big")
        if (flags if e.get("exact", True) is not False else flags | want) != want:
            return False
    return all(b[start + d["offset"] :].startswith(bytes.fromhex(d["value"])) if len(d["value"]) < 64 else b[start + d["offset"] : start + d["offset"] + len(d["value"]) // 2].hex() == d["value"] for d in e.get("data") or [])


def box_digest(b: bytes, assertion: dict, marked: bool) -> str | None:
    """Digest of an ISO media file outside of the boxes, or parts of them, that exclusions name.

    marked: the offset of each outer box that isn't left out whole is hashed before its first byte, from the first
    to the last byte that is covered.  Digests of fragments (merkle) aren't computed.
    """
    h = new_hash(assertion.get("alg"))
    if h is None or assertion.get("merkle") is not None:
        return None
    found, spans = list(places(b)), []
    for e in assertion.get("exclusions") or []:
        for p in found:
            if _meant(b, p, e):
                _, start, size, _, _ = p
                for s in e.get("subset") or []:
                    if s["offset"] <= size:
                        spans.append((start + s["offset"], start + (min(s["offset"] + s["length"], size) if s["length"] else size), False))
                if not e.get("subset"):
                    spans.append((start, start + size, True))
    first, last = 0, len(b)
    for start, stop, _ in sorted(spans):
        first = max(first, stop) if start <= first else first
    for start, stop, _ in sorted(spans, key=lambda s: (-s[1], -s[0])):
        last = min(last, start) if stop >= last else last
    whole = {start for start, _, all_ in spans if all_}
    marks = [start for _, start, _, _, outer in found if outer and start not in whole and first <= start < last] if marked else []
    at, view = 0, memoryview(b)
    for start, stop, mark in sorted([(m, m, True) for m in marks] + [(x, y, False) for x, y, _ in spans]):
        h.update(view[at : max(at, start)])
        if mark:
            h.update(start.to_bytes(8, "big"))
        at = max(at, stop)
    h.update(view[at:])
    return h.hexdigest()


def bound(b: bytes, assertions: dict[str, dict]) -> tuple[str, str | None, str | None] | None:
    """(label, wanted digest, digest of the file) of the assertion that binds a manifest to its file.

    A digest of byte ranges comes before one of ISO media boxes, of those the newest form; digests of single boxes
    aren't computed, and the file's is None.
    """
    names = [k for k in assertions if k.startswith(("c2pa.hash.data", "c2pa.hash.bmff", "c2pa.hash.boxes"))]
    if not names:
        return None
    label = max(names, key=lambda k: (k.startswith("c2pa.hash.data"), not k.startswith("c2pa.hash.boxes"), k))
    a = assertions[label] if isinstance(assertions[label], dict) else {}
    if label.startswith("c2pa.hash.data"):
        got = data_digest(b, a)
    else:
        got = box_digest(b, a, ".v2" in label or ".v3" in label) if label.startswith("c2pa.hash.bmff") else None
    return label, a.get("hash"), got
