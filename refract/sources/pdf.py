"""PDF files as rows of boxes: cross-reference sections newest first, information strings, XMP texts.

An incremental update appends a section whose trailer points to the one before it, so the chain from ``startxref``
along ``Prev`` tells how often a file was saved again after it was made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

# Escapes of literal strings, and entries of a PDF's information dictionary.
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
KEYS = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")

_ENTRY = re.compile(rb"/(" + "|".join(KEYS).encode() + rb")\s*(\(|<(?!<))")
_PIECE = re.compile(rb"\\(?:[0-7]{1,3}|\r\n|.)|[()]|[^\\()]+", re.S)
_XMP = re.compile(rb"<x:xmpmeta.*?</x:xmpmeta>", re.S | re.I)
_HEADER = re.compile(rb"%PDF-(\d\.\d)")
_START = re.compile(rb"startxref\s+(\d+)")
_PREV, _STREAM = re.compile(rb"/Prev\s+(\d+)"), re.compile(rb"\d+\s+\d+\s+obj\b")


def literal(b: bytes, at: int) -> tuple[bytes, int] | None:
    """(bytes, end) of the literal string that opens at a parenthesis: nested ones balance, octal and line escapes are read."""
    out, depth = [], 0
    for m in _PIECE.finditer(b, at):
        x = m[0]
        if x == b"(":
            depth += 1
            if depth == 1:
                continue
        elif x == b")":
            depth -= 1
            if not depth:
                return b"".join(out), m.end()
        elif x[:1] == b"\\":
            rest = x[1:]
            x = bytes([int(rest, 8) & 255]) if rest.isdigit() and rest[:1] < b"8" else b"" if rest in (b"\n", b"\r", b"\r\n") else ESCAPES.get(rest, rest)
        out.append(x)
    return None


def hexadecimal(b: bytes, at: int) -> tuple[bytes, int] | None:
    end = b.find(b">", at)
    digits = re.sub(rb"\s", b"", b[at + 1 : end]) if end >= 0 else b"?"
    return (bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("latin-1")), end + 1) if re.fullmatch(rb"[0-9A-Fa-f]*", digits) else None


def text(data: bytes) -> str:
    """Text of a string's bytes: UTF-16 or UTF-8 by their marks, else Latin-1."""
    if data[:2] in (b"\xfe\xff", b"\xff\xfe"):
        out = data.decode("utf-16", "replace")
    elif data[:3] == b"\xef\xbb\xbf":
        out = data[3:].decode("utf-8", "replace")
    else:
        out = data.decode("latin-1")
    return out.replace("\0", "").strip()


def _sections(b: bytes) -> Iterator[tuple[str, int, int, bytes]]:
    """Cross-reference sections from the last ``startxref`` along ``Prev``: a chain that leads nowhere ends as ``xref.lost``."""
    starts = _START.findall(b[-2048:]) or _START.findall(b)
    at, seen = int(starts[-1]) if starts else -1, set()
    while at >= 0 and at not in seen:
        seen.add(at)
        table = b[at : at + 4] == b"xref"
        if not table and not _STREAM.match(b, at):
            yield "xref.lost", at, 0, b""
            return
        # The dictionary is the trailer's, or that of the stream object itself.
        lo = b.find(b"trailer", at) if table else at
        hi = -1 if lo < 0 else b.find(b"startxref" if table else b"stream", lo)
        words = b[lo : hi if hi >= 0 else lo + 4096] if lo >= 0 else b""
        yield "xref", at, max(hi, lo, at) - at, words
        prev = _PREV.search(words)
        at = int(prev[1]) if prev else -1


def pdf(b: bytes) -> Iterator[tuple[str, int, int, bytes]]:
    """Boxes of a file: header, xref (payload: the trailer's dictionary), info.* (text in UTF-8) and xmp."""
    if m := _HEADER.search(b, 0, 1024):
        yield "header", m.start(), len(m[0]), m[1]
    if b.find(b"/Linearized", 0, 2048) >= 0:
        yield "linearized", 0, 0, b""
    yield from _sections(b)
    for m in _ENTRY.finditer(b):
        found = literal(b, m.end() - 1) if m[2] == b"(" else hexadecimal(b, m.end() - 1)
        if found:
            yield f"info.{m[1].decode()}", m.start(), found[1] - m.start(), text(found[0]).encode()
    for m in _XMP.finditer(b):
        yield "xmp", m.start(), len(m[0]), m[0]
