"""Signatures of manifests and their certificates as rows: what was signed, by which key, under which name."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .manifests import NO_STORE, Manifest, _boxes, cbor, opened

# Name parts, signature algorithms and digests by object id, COSE algorithms by number.
NAMES = {"550403": "CN", "55040a": "O", "55040b": "OU", "550406": "C", "550408": "ST", "550407": "L"}
ALGORITHMS = {
    "2a8648ce3d040302": ("ecdsa", "sha256"), "2a8648ce3d040303": ("ecdsa", "sha384"), "2a8648ce3d040304": ("ecdsa", "sha512"), "2a864886f70d01010b": ("rsa", "sha256"), "2a864886f70d01010c": ("rsa", "sha384"),
    "2a864886f70d01010d": ("rsa", "sha512"), "2a864886f70d01010a": ("pss", "sha1"), "2b6570": ("ed25519", "sha512"),
}
DIGESTS = {"608648016503040201": "sha256", "608648016503040202": "sha384", "608648016503040203": "sha512", "2b0e03021a": "sha1"}
COSE = {-7: ("ecdsa", "sha256", 0), -35: ("ecdsa", "sha384", 0), -36: ("ecdsa", "sha512", 0), -37: ("pss", "sha256", 32), -38: ("pss", "sha384", 48), -39: ("pss", "sha512", 64), -8: ("ed25519", "sha512", 0)}

DAMAGE = (ValueError, IndexError, struct.error, TypeError, KeyError, AttributeError)

SIGNATURES = "path string, manifest int, active boolean, alg int, kind string, digest string, salt int, message binary, signature binary, chain array<binary>, signed_at string, error string"
CERTIFICATES = (
    "subject_name string, subject_org string, subject_country string, issuer_name string, issuer_org string, not_before string, not_after string, kind string, digest string, salt int, key_kind string, key binary, "
    "message binary, signature binary, subject_der binary, issuer_der binary, error string"
)


def _head(major: int, n: int) -> bytes:
    width = 0 if n < 24 else 1 if n < 256 else 2 if n < 65536 else 4
    return bytes([major << 5 | (n if not width else 23 + width.bit_length())]) + (n.to_bytes(width, "big") if width else b"")


def to_be_signed(protected: bytes, payload: bytes) -> bytes:
    """The array of context, protected header, nothing and payload that a COSE signature covers."""
    text = b"Signature1"
    return b"\x84" + _head(3, len(text)) + text + _head(2, len(protected)) + protected + b"\x40" + _head(2, len(payload)) + payload


def _signed_at(unprotected: dict) -> str | None:
    """The time inside the first token of a time stamp."""
    stamp = unprotected.get("sigTst2") or unprotected.get("sigTst") or {}
    token = bytes.fromhex(((stamp.get("tstTokens") or [{}])[0]).get("val") or "")
    found = re.search(rb"\x18\x0f([23]\d{3})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)Z", token)
    return "{}-{}-{}T{}:{}:{}Z".format(*(g.decode() for g in found.groups())) if found else None


def _signed(store: bytes, parts: dict) -> tuple:
    """alg, kind, digest, salt, message, signature, chain and time of a manifest's signature."""
    body = lambda part: next((store[x:y] for kind, _, x, y in _boxes(store, part.body, part.end) if kind == "cbor"), b"")
    claim = body(parts.get("c2pa.claim") or parts["c2pa.claim.v2"])
    protected, unprotected, payload, signature = cbor(body(parts["c2pa.signature"]))[0]
    protected = bytes.fromhex(protected)
    header = cbor(protected)[0] if protected else {}
    alg = header.get("1")
    chain = header.get("33") or unprotected.get("33") or unprotected.get("x5chain") or header.get("x5chain") or []
    chain = [bytes.fromhex(c) for c in ([chain] if isinstance(chain, str) else chain)]
    kind, digest, salt = COSE.get(alg, (None, None, None))
    signed = to_be_signed(protected, bytes.fromhex(payload) if payload else claim)
    return alg, kind, digest, salt, signed, bytes.fromhex(signature), chain, _signed_at(unprotected)


def signature_of(store: bytes, m: Manifest) -> tuple[dict, list[bytes]]:
    """The signature of a manifest, or its error, and its certificates."""
    try:
        _, kind, digest, salt, message, signature, chain, at = _signed(store, m.parts)
    except DAMAGE as e:
        return {"error": f"{type(e).__name__}: {e}"}, []
    return {"kind": kind, "digest": digest, "salt": salt, "message": message, "signature": signature, "signed_at": at, "error": None if chain else "no certificate in signature"}, chain


def _signatures(content: bytes) -> Iterator[tuple]:
    found = opened(content)
    if not found:
        return
    _, store, manifests, error = found
    if error and (manifests or error != NO_STORE):
        raise ValueError(error)
    for m in manifests:
        last = m.number == len(manifests) - 1
        try:
            *most, chain, at = _signed(store, m.parts)
            yield m.number, last, *most, chain, at, None if chain else "no certificate in signature"
        except DAMAGE as e:
            yield m.number, last, None, None, None, None, None, None, [], None, f"{type(e).__name__}: {e}"


def signatures(files: DataFrame) -> DataFrame:
    """One row a manifest of files (path, content): algorithm, signed bytes, signature, certificates, time stamp; or an error."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content):
                try:
                    rows += [(path, *r) for r in _signatures(content or b"")]
                except DAMAGE as e:
                    rows.append((path, None, True, None, None, None, None, None, None, [], None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SIGNATURES.split(", ")], dtype=object)

    return files.select("path", "content").mapInPandas(walk, SIGNATURES)


def der(b: bytes, at: int = 0) -> tuple[int, int, int, int]:
    """(tag, start, start of the body, end) of a DER value."""
    tag, n, body = b[at], b[at + 1], at + 2
    if n & 0x80:
        body, n = body + (n & 0x7F), int.from_bytes(b[body : body + (n & 0x7F)], "big")
    if body + n > len(b):
        raise ValueError("value ends early")
    return tag, at, body, body + n


def inside(b: bytes, node: tuple[int, int, int, int]) -> list[tuple[int, int, int, int]]:
    out, at = [], node[2]
    while at < node[3]:
        out.append(der(b, at))
        at = out[-1][3]
    return out


def moment(b: bytes, node: tuple[int, int, int, int]) -> str:
    """ISO text of a UTCTime (years from 1950) or a GeneralizedTime."""
    text = b[node[2] : node[3]].decode("latin-1")
    if node[0] == 0x17:
        text = ("19" if text[:2] >= "50" else "20") + text
    return f"{text[:4]}-{text[4:6]}-{text[6:8]}T{text[8:10]}:{text[10:12]}:{text[12:14] if text[12:14].isdigit() else '00'}Z"


def certificate(b: bytes) -> tuple:
    body = lambda node: b[node[2] : node[3]]
    tbs, algorithm, bits = inside(b, der(b))
    fields = inside(b, tbs)
    fields = fields[1:] if fields[0][0] == 0xA0 else fields
    issuer, validity, subject, spki = fields[2:6]

    def name(node):
        pairs = [inside(b, pair) for group in inside(b, node) for pair in inside(b, group)]
        out: dict[str, str] = {}
        for oid, value in pairs:
            out.setdefault(NAMES.get(body(oid).hex(), ""), body(value).decode("utf-16-be" if value[0] == 0x1E else "utf-8", "replace"))
        return out

    oid, *parameters = inside(b, algorithm)
    kind, digest = ALGORITHMS.get(body(oid).hex(), (None, None))
    salt, signature = 0, b[bits[2] + 1 : bits[3]]
    if kind == "pss":
        salt = 20
        for p in inside(b, parameters[0]) if parameters else []:
            value = inside(b, p)[0]
            if p[0] == 0xA0:
                digest = DIGESTS.get(body(inside(b, value)[0]).hex(), digest)
            elif p[0] == 0xA2:
                salt = int.from_bytes(body(value), "big")
    if kind == "ecdsa":
        # As wide as the largest curve, so that halves are told by length alone.
        signature = b"".join(int.from_bytes(signature[x:y], "big").to_bytes(66, "big") for _, _, x, y in inside(signature, der(signature)))
    key_algorithm, key_bits = inside(b, spki)
    key_oid, *key_parameters = inside(b, key_algorithm)
    key, key_kind = b[key_bits[2] + 1 : key_bits[3]], body(key_oid).hex()
    if key_kind == "2a8648ce3d0201":
        key_kind = body(key_parameters[0]).hex()
    elif key_kind in ("2a864886f70d010101", "2a864886f70d01010a"):
        n, e = (key[x:y].lstrip(b"\0") for _, _, x, y in inside(key, der(key)))
        key_kind, key = "rsa", len(n).to_bytes(4, "big") + n + e
    elif key_kind == "2b6570":
        key_kind = "ed25519"
    s, i = name(subject), name(issuer)
    start, end = inside(b, validity)
    whole = lambda node: b[node[1] : node[3]]
    return s.get("CN"), s.get("O"), s.get("C"), i.get("CN"), i.get("O"), moment(b, start), moment(b, end), kind, digest, salt, key_kind, key, whole(tbs), signature, whole(subject), whole(issuer), None


def certificates(rows: DataFrame, column: str = "der") -> DataFrame:
    """The rows with ``cert``: names, validity, key and signed part of the certificate in a binary column; damage is its ``error``."""
    names = [c.split()[0] for c in CERTIFICATES.split(", ")]

    @F.pandas_udf(CERTIFICATES)
    def parse(values: pd.Series) -> pd.DataFrame:
        def one(v):
            try:
                return certificate(bytes(v))
            except DAMAGE as e:
                return (None,) * (len(names) - 1) + (f"{type(e).__name__}: {e}",)

        return pd.DataFrame([one(v) for v in values], columns=names, dtype=object)

    return rows.withColumn("cert", parse(column))
