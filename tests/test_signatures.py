"""Signatures made by Java's own providers, certificates built here, and what each change does to the verdict."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from refract.functions.crypto import holds
from refract.operators import signatures as S
from refract.sources.certificates import certificate, signatures, to_be_signed
from refract.sources.walk import walk

from .test_provenance import ACTIONS, box, changed, encode, jumb


class Java:
    """Keys and signatures of the JVM."""

    def __init__(self, spark, kind: str, size):
        self.jvm = spark._jvm
        g = self.jvm.java.security.KeyPairGenerator.getInstance(kind)
        if isinstance(size, str):
            g.initialize(self.jvm.java.security.spec.ECGenParameterSpec(size))
        elif size:
            g.initialize(size)
        pair = g.generateKeyPair()
        form = self.jvm.java.lang.Class.forName("java.security.spec.X509EncodedKeySpec")
        spec = self.jvm.java.security.KeyFactory.getInstance(kind).getKeySpec(pair.getPublic(), form)
        self.spki, self.private = bytes(spec.getEncoded()), pair.getPrivate()

    def sign(self, algorithm: str, message: bytes, salt: int = 0) -> bytes:
        s = self.jvm.java.security.Signature.getInstance(algorithm)
        if salt:
            digest = {32: "SHA-256", 48: "SHA-384", 64: "SHA-512"}[salt]
            spec = self.jvm.java.security.spec
            s.setParameter(spec.PSSParameterSpec(digest, "MGF1", spec.MGF1ParameterSpec(digest), salt, 1))
        s.initSign(self.private)
        s.update(bytearray(message))
        return bytes(s.sign())


def tlv(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x81" + bytes([n]) if n < 256 else b"\x82" + n.to_bytes(2, "big")) + body


def cert(subject: str, spki: bytes, issuer: str, key: Java, algorithm: str = "SHA256withECDSA", oid: str = "2a8648ce3d040302", until: bytes = b"20900101000000Z") -> bytes:
    name = lambda n: tlv(0x30, tlv(0x31, tlv(0x30, tlv(6, b"\x55\4\3"), tlv(12, n.encode()))), tlv(0x31, tlv(0x30, tlv(6, b"\x55\4\x0a"), tlv(12, b"Org"))))
    alg = tlv(0x30, tlv(6, bytes.fromhex(oid)))
    tbs = tlv(0x30, tlv(0xA0, tlv(2, b"\2")), tlv(2, b"\1"), alg, name(issuer), tlv(0x30, tlv(0x17, b"200101000000Z"), tlv(0x18, until)), name(subject), spki)
    return tlv(0x30, tbs, alg, tlv(3, b"\0", key.sign(algorithm, tbs)))


KEYS = {
    "P-256": ("EC", "secp256r1", "SHA256withECDSA", "ecdsa", "sha256", 0), "P-384": ("EC", "secp384r1", "SHA384withECDSA", "ecdsa", "sha384", 0), "P-521": ("EC", "secp521r1", "SHA512withECDSA", "ecdsa", "sha512", 0),
    "pkcs1": ("RSA", 2048, "SHA256withRSA", "rsa", "sha256", 0), "pss": ("RSA", 2048, "RSASSA-PSS", "pss", "sha256", 32), "pss 384": ("RSA", 2041, "RSASSA-PSS", "pss", "sha384", 48), "ed25519": ("Ed25519", None, "Ed25519", "ed25519", "sha512", 0),
}


@pytest.mark.parametrize("name", sorted(KEYS))
def test_signatures_of_the_jvm(spark, name):
    kind, size, algorithm, family, digest, salt = KEYS[name]
    key, ca = Java(spark, kind, size), Java(spark, "EC", "secp256r1")
    parsed = certificate(cert("leaf", key.spki, "root", ca))
    key_kind, public = parsed[10], parsed[11]
    message = b"to be signed " * 9
    made = key.sign(algorithm, message, salt)
    if family == "ecdsa":
        made = certificate(cert("self", key.spki, "self", key, algorithm, {"sha256": "2a8648ce3d040302", "sha384": "2a8648ce3d040303", "sha512": "2a8648ce3d040304"}[digest]))
        message, made = made[12], made[13]
    assert holds(family, digest, salt, key_kind, public, message, made) is True
    assert holds(family, digest, salt, key_kind, public, message + b"x", made) is False
    assert holds(family, digest, salt, "1.2.3", public, message, made) is None


def signed(leaf: Java, chain: list[bytes], body: bytes = b"pixels " * 40, stamp: str | None = None) -> bytes:
    def store(length):
        data = {"exclusions": [{"start": len(body), "length": length}], "hash": hashlib.sha256(body + b"TAIL").digest(), "alg": "sha256"}
        made = {k: jumb(k, box(b"cbor", encode(v))) for k, v in {"c2pa.hash.data": data, "c2pa.actions": ACTIONS}.items()}
        refs = [{"url": f"self#jumbf=c2pa.assertions/{k}", "hash": hashlib.sha256(b[8:]).digest()} for k, b in made.items()]
        claim = encode({"claim_generator": "maker/1", "alg": "sha256", "assertions": refs})
        protected = encode({1: -7, 33: chain})
        r = certificate_signature(leaf, to_be_signed(protected, claim))
        free = {"sigTst": {"tstTokens": [{"val": b"\x30\x18\x0f" + stamp.encode() + b"\0"}]}} if stamp else {}
        return jumb("c2pa", jumb("urn:new", jumb("c2pa.assertions", *made.values()), jumb("c2pa.claim", box(b"cbor", claim)), jumb("c2pa.signature", box(b"cbor", encode([protected, free, None, r])))), kind=b"c2pa")

    length = 60_000
    while len(store(length)) != length:
        length = len(store(length))
    return body + store(length) + b"TAIL"


def unknown(der: bytes) -> bytes:
    """A certificate whose signature algorithm isn't known (the outer name of it; what is signed stays)."""
    at = der.rindex(bytes.fromhex("2a8648ce3d0403"))
    return der[: at + 7] + b"\x7f" + der[at + 8 :]


def broken_key(der: bytes) -> bytes:
    """A certificate whose public key is no point of its curve."""
    at = der.index(b"\x03\x42\x00\x04")
    return der[: at + 10] + bytes([der[at + 10] ^ 1]) + der[at + 11 :]


def certificate_signature(key: Java, message: bytes) -> bytes:
    """r and s side by side."""
    der = key.sign("SHA256withECDSA", message)
    n = der[3]
    r, s = der[4 : 4 + n], der[6 + n :]
    return int.from_bytes(r, "big").to_bytes(32, "big") + int.from_bytes(s, "big").to_bytes(32, "big")


def test_verdicts(spark):
    root, middle, leaf, other = (Java(spark, "EC", "secp256r1") for _ in range(4))
    anchor = cert("root", root.spki, "root", root)
    chain = [cert("leaf", leaf.spki, "middle", middle), cert("middle", middle.spki, "root", root)]
    good = signed(leaf, chain)
    old = [cert("leaf", leaf.spki, "middle", middle, until=b"20210101000000Z"), chain[1]]
    cases = {
        "good": (good, "valid"), "pixel": (changed(good, 3), "invalid"), "claim": (changed(good, good.index(b"maker/1")), "invalid"), "forged": (signed(other, chain), "invalid"),
        "chain": (signed(leaf, [cert("leaf", leaf.spki, "middle", other), chain[1]]), "invalid"), "top": (signed(leaf, [chain[0], cert("middle", middle.spki, "root", other)]), "valid_untrusted"), "untrusted": (signed(leaf, [cert("leaf", leaf.spki, "nobody", other)]), "valid_untrusted"),
        "unknown link": (signed(leaf, [unknown(cert("leaf", leaf.spki, "root", other)), anchor]), "partial"), "unknown top": (signed(leaf, [unknown(cert("leaf", leaf.spki, "root", other))]), "valid_untrusted"),
        "damaged link": (signed(leaf, [cert("leaf", leaf.spki, "middle", middle), broken_key(chain[1])]), "invalid"), "signer is a root": (signed(root, [anchor]), "valid"),
        "expired": (signed(leaf, old), "invalid"), "stamped": (signed(leaf, old, stamp="20200601000000Z"), "valid"), "no chain": (signed(leaf, []), "unreadable"), "damaged": (signed(leaf, [b"\x30\x82\xff\xff"]), "unreadable"),
    }
    files = spark.createDataFrame([(n, bytearray(b)) for n, (b, _) in cases.items()] + [("plain", bytearray(b"nothing")), ("null", None)], "path string, content binary").repartition(3).cache()
    anchors = spark.createDataFrame([(bytearray(anchor),), (bytearray(anchor),), (None,)], "der binary")
    rows = {r.path: r for r in S.verdict(walk(files), anchors, F.lit("2026-01-01T00:00:00Z")).collect()}
    assert {n: r.status for n, r in rows.items()} == {n: s for n, (_, s) in cases.items()}
    top = rows["stamped"]
    assert (top.signer, top.organization, top.issuer, top.signed_at, top.trusted_by) == ("leaf", "Org", "middle · Org", "2020-06-01T00:00:00Z", "root · Org")
    assert rows["good"].headline.startswith("Verified: signed by leaf")
    assert all(rows[n].trusted_by is None for n in ("unknown link", "unknown top", "damaged link"))
    assert S.verdict(walk(files.limit(0)), anchors.limit(0)).count() == 0
    assert {r.status for r in S.verdict(walk(files), anchors.limit(0), F.lit("2026-01-01T00:00:00Z")).where("path IN ('good', 'signer is a root')").collect()} == {"valid_untrusted"}


def test_rows_of_signatures(spark):
    leaf = Java(spark, "EC", "secp256r1")
    files = spark.createDataFrame([("a", bytearray(signed(leaf, [b"der"]))), ("b", bytearray(b"none")), ("c", None)], "path string, content binary")
    row = signatures(files).collect()
    assert [(r.path, r.manifest, r.active, r.kind, r.chain) for r in row] == [("a", 0, True, "ecdsa", [b"der"])]


def test_history_of_three(spark):
    """A forged signature, a changed assertion or a lost claim anywhere in the history makes the newest manifest invalid."""
    keys = [Java(spark, "EC", "secp256r1") for _ in range(3)]
    chains = [[cert(f"signer {i}", k.spki, "nobody", k)] for i, k in enumerate(keys)]

    def one(i: int, key: Java, assertions: dict, alg: int = -7) -> bytes:
        made = {k: jumb(k, box(b"cbor", encode(v))) for k, v in assertions.items()}
        claim = encode({"claim_generator": f"maker/{i}", "alg": "sha256", "assertions": [{"url": f"x/{k}", "hash": hashlib.sha256(b[8:]).digest()} for k, b in made.items()]})
        protected = encode({1: alg, 33: chains[i]})
        return jumb(f"urn:{i}", jumb("c2pa.assertions", *made.values()), jumb("c2pa.claim", box(b"cbor", claim)), jumb("c2pa.signature", box(b"cbor", encode([protected, {}, None, certificate_signature(key, to_be_signed(protected, claim))]))))

    def file(forge: int | None = None, edit=lambda i, b: b, alg: int = -7) -> bytes:
        made: list[bytes] = []
        for i, key in enumerate(keys):
            past = {"c2pa.ingredient": {"c2pa_manifest": {"url": f"self#jumbf=/c2pa/urn:{i - 1}", "hash": hashlib.sha256(made[-1][8:]).digest()}}} if made else {}
            if i < 2:
                made.append(edit(i, one(i, keys[2] if forge == i else key, {"c2pa.actions": ACTIONS, **past}, alg if i == 1 else -7)))
        def store(length):  # noqa: E306
            data = {"exclusions": [{"start": 4, "length": length}], "hash": hashlib.sha256(b"HEADTAIL").digest()}
            return jumb("c2pa", *made, one(2, keys[2], {"c2pa.hash.data": data, **past}), kind=b"c2pa")
        n = 9000  # noqa: E305
        for _ in range(5):
            n = len(store(n))
        return b"HEAD" + store(n) + b"TAIL"

    cases = {
        "good": (file(), "valid_untrusted"), "forged first": (file(0), "invalid"), "forged middle": (file(1), "invalid"), "unknown algorithm": (file(alg=-99), "partial"),
        "assertion": (file(edit=lambda i, b: changed(b, b.index(b"Painter")) if i == 0 else b), "invalid"), "no claim": (file(edit=lambda i, b: b.replace(b"c2pa.claim\0", b"c2pa.klaim\0") if i == 0 else b), "invalid"),
    }
    files = spark.createDataFrame([(n, bytearray(b)) for n, (b, _) in cases.items()], "path string, content binary")
    anchors = spark.createDataFrame([], "der binary")
    assert {r.path: r.status for r in S.verdict(walk(files), anchors, F.lit("2026-01-01T00:00:00Z")).collect()} == {n: s for n, (_, s) in cases.items()}
    told = {(r.path, r.manifest): (r.depth, r.signer, r.signed, r.intact) for r in S.history(walk(files)).collect()}
    assert [told["good", i] for i in range(3)] == [(2 - i, f"signer {i}", True, True) for i in range(3)]
    assert told["forged middle", 1] == (1, "signer 1", False, True) and told["assertion", 0][3] is False and told["unknown algorithm", 1][2] is None
