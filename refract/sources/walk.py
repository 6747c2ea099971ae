"""One walk over each file with provenance: a row that holds all that its checks compare.

A file is read once; what is wanted and what was found stand side by side in ``facts``, and the manifests carry
their signatures and parsed certificates, so every check after it is an expression over one row (operators).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .binding import bound, new_hash
from .certificates import CERTIFICATES, DAMAGE, certificate, signature_of
from .manifests import Manifest, opened

_CERT = [c.split() for c in CERTIFICATES.split(", ")]
_SIGNATURE = "kind:string,digest:string,salt:int,message:binary,signature:binary,signed_at:string,error:string"
#: kind of a fact: assertion (listed in a claim), ingredient (an earlier manifest that one names), content (the file).
FACTS = (
    "path string, container string, error string, "
    f"manifests array<struct<label:string,depth:int,claim:string,assertions:array<struct<label:string,content:string>>,signature:struct<{_SIGNATURE}>,chain:array<struct<der:binary,{','.join(':'.join(c) for c in _CERT)}>>>>, "
    "facts array<struct<kind:string,manifest:int,label:string,found:boolean,want:string,got:string,also:string>>"
)


@lru_cache(4096)
def _certificate(der: bytes) -> dict:
    """A parsed certificate; equal ones are parsed once in a task."""
    try:
        values = certificate(der)
    except DAMAGE as e:
        values = (None,) * (len(_CERT) - 1) + (f"{type(e).__name__}: {e}",)
    return {"der": der, **dict(zip((n for n, _ in _CERT), values))}


def _tail(url) -> str:
    return str(url or "").rpartition("/")[2]


def _references(claim: dict) -> Iterator[tuple[str, str | None, str | None]]:
    """(label, alg, digest) of what a claim lists."""
    for k in ("assertions", "created_assertions", "gathered_assertions"):
        for ref in claim.get(k) or []:
            yield _tail(ref.get("url")), ref.get("alg") or claim.get("alg"), ref.get("hash")


def _digest(alg: str | None, data: bytes) -> str | None:
    h = new_hash(alg)
    if h is None:
        return None
    h.update(data)
    return h.hexdigest()


def _facts(b: bytes, store: bytes, manifests: list[Manifest]) -> Iterator[dict]:
    fact = lambda *v: dict(zip(("kind", "manifest", "label", "found", "want", "got", "also"), v))
    cut = lambda part: store[part.body : part.end]
    for m in manifests:
        claim = m.claim if isinstance(m.claim, dict) else {}
        for label, alg, want in _references(claim):
            part = m.assertions.get(label)
            yield fact("assertion", m.number, label, part is not None, want, _digest(alg, cut(part)) if part else None, None)
        for label, part in m.assertions.items():
            value = part.value if isinstance(part.value, dict) and label.startswith("c2pa.ingredient") else {}
            ref = value.get("c2pa_manifest") or value.get("activeManifest") or {}
            target = next((x for x in manifests if x.label == _tail(ref.get("url"))), None)
            if target is not None:
                alg = ref.get("alg") or claim.get("alg")
                yield fact("ingredient", m.number, target.label, True, ref.get("hash"), _digest(alg, cut(target)), _digest(alg, store[target.start : target.end]))
    found = bound(b, {label: part.value for label, part in manifests[-1].assertions.items()}) if manifests else None
    if found:
        yield fact("content", manifests[-1].number, found[0], True, found[1], found[2], None)


def _depths(manifests: list[Manifest], facts: list[dict]) -> dict[int, int]:
    """How many ingredients lie between the newest manifest and each one that it comes from."""
    names = {m.label: m.number for m in manifests}
    depth = {manifests[-1].number: 0} if manifests else {}
    queue = list(depth)
    for at in queue:
        for f in facts:
            to = names.get(f["label"])
            if f["kind"] == "ingredient" and f["manifest"] == at and to is not None and to not in depth:
                depth[to] = depth[at] + 1
                queue.append(to)
    return depth


def read(b: bytes) -> dict | None:
    """What one file's store says; None without a store."""
    found = opened(b)
    if found is None:
        return None
    container, store, manifests, error = found
    facts = list(_facts(b, store, manifests))
    depth = _depths(manifests, facts)
    out = []
    for m in manifests:
        signature, chain = signature_of(store, m)
        text = lambda v: None if v is None else json.dumps(v)
        out.append(
            {
                "label": m.label, "depth": depth.get(m.number), "claim": text(m.claim), "assertions": [{"label": k, "content": text(p.value)} for k, p in m.assertions.items()],
                "signature": signature, "chain": [_certificate(c) for c in chain],
            }
        )
    return {"container": container, "error": error, "manifests": out, "facts": facts}


def walk(files: DataFrame, keep: tuple[str, ...] = (), every: bool = False) -> DataFrame:
    """A row for each file (path, content) with provenance: container, error, manifests and facts.

    * null or empty content, and files without a store, give no row, or with ``every`` one without container and error;
    * a damaged store gives a row with its error;
    * of the other columns those in ``keep`` come along, others are not read.
    """
    kinds = to_arrow_schema(StructType.fromDDL(FACTS))
    more = StructType([files.schema[k] for k in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (path, content) in enumerate(zip(batch.column("path").to_pylist(), batch.column("content"))):
                try:
                    row = read(content.as_py() or b"")
                except DAMAGE as e:
                    row = {"error": f"{type(e).__name__}: {e}", "manifests": [], "facts": []}
                if row or every:
                    told = pa.RecordBatch.from_pylist([{"path": path, **(row or {"manifests": [], "facts": []})}], kinds)
                    yield pa.RecordBatch.from_arrays([*told.columns, *(batch.column(k).slice(i, 1) for k in keep)], [*told.schema.names, *keep])

    return files.select("path", "content", *keep).mapInArrow(run, StructType(StructType.fromDDL(FACTS).fields + more.fields))
