"""PCM audio of WAV, AIFF and CAF files as overlapping segments, and WAV bytes from samples."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW, HOP = 2048, 512
#: Frames that a segment owns, and frames before them that warm up the mask smoothing.
SEGMENT_FRAMES, WARM_UP = 1024, 16

SEGMENTS = "path string, sample_rate int, n_samples bigint, channels int, seg int, start bigint, samples array<float>"


def _chunks(b: bytes, at: int, order: str, head: int = 8) -> Iterator[tuple[bytes, int, int]]:
    while at + head <= len(b):
        size = int.from_bytes(b[at + 4 : at + head], order)
        yield b[at : at + 4], at + head, size
        at += head + size + (size % 2 if head == 8 else 0)


def _number80(b: bytes) -> float:
    """An 80-bit extended float."""
    return int.from_bytes(b[2:10], "big") * 2.0 ** ((int.from_bytes(b[:2], "big") & 0x7FFF) - 16383 - 63)


def pcm_layout(b: bytes, length: int | None = None) -> tuple[int, int, int, bool, str, int, int] | None:
    """(rate, channels, bits, is float, byte order, offset, bytes) of the samples; null for what isn't PCM.

    b: the file, or its start where ``length`` tells how long it is.  A RIFF size of 0 or all ones means to the end.
    """
    fmt = data = None
    whole = len(b) if length is None else length
    if b[:4] == b"RIFF" and b[8:12] == b"WAVE":
        for name, at, size in _chunks(b, 12, "little"):
            if name == b"fmt ":
                fmt = struct.unpack_from("<HHIIHH", b, at)
            elif name == b"data" and fmt and fmt[0] in (1, 3, 0xFFFE):
                kind = struct.unpack_from("<H", b, b.find(b"fmt ") + 32)[0] if fmt[0] == 0xFFFE else fmt[0]
                return fmt[2], fmt[1], fmt[5], kind == 3, "<", at, min(size if size not in (0, 0xFFFFFFFF) or length is None else whole, whole - at)
    elif b[:4] == b"FORM" and b[8:12] in (b"AIFF", b"AIFC"):
        kind = b"NONE"
        for name, at, size in _chunks(b, 12, "big"):
            if name == b"COMM":
                fmt = (int(_number80(b[at + 8 : at + 18])), *struct.unpack_from(">H", b, at), *struct.unpack_from(">H", b, at + 6))
                kind = b[at + 18 : at + 22] if b[8:12] == b"AIFC" else kind
            elif name == b"SSND":
                data = (at + 8, min(size - 8, whole - at - 8))
        if fmt and data and kind in (b"NONE", b"twos", b"sowt", b"fl32", b"FL32", b"fl64", b"FL64", b"in24", b"in32"):
            return fmt[0], fmt[1], fmt[2], kind.lower() in (b"fl32", b"fl64"), "<" if kind == b"sowt" else ">", *data
    elif b[:4] == b"caff":
        for name, at, size in _chunks(b, 8, "big", 12):
            if name == b"desc":
                fmt = struct.unpack_from(">d4sIIIII", b, at)
            elif name == b"data" and fmt and fmt[1] == b"lpcm":
                return int(fmt[0]), fmt[5], fmt[6], bool(fmt[2] & 1), "<" if fmt[2] & 2 else ">", at + 4, whole - at - 4
    return None


def unpack(b: bytes, bits: int, is_float: bool, order: str, unsigned8: bool = True) -> np.ndarray:
    """Samples of -1 to 1."""
    if is_float:
        return np.frombuffer(b, f"{order}f{bits // 8}").astype(np.float32)
    if bits == 8:
        return (np.frombuffer(b, np.uint8).astype(np.float32) - 128) / 128 if unsigned8 else np.frombuffer(b, np.int8).astype(np.float32) / 128
    if bits == 24:
        x = np.frombuffer(b, np.uint8).reshape(-1, 3).astype(np.int32)
        x = x if order == "<" else x[:, ::-1]
        return ((x[:, 0] << 8 | x[:, 1] << 16 | x[:, 2] << 24) >> 8).astype(np.float32) / 8388608
    return np.frombuffer(b, f"{order}i{bits // 8}").astype(np.float32) / 2.0 ** (bits - 1)


def segments(files: DataFrame, frames: int = SEGMENT_FRAMES) -> DataFrame:
    """Interleaved samples of each segment with its halo: what its frames, and the warm-up before them, cover.

    files: path, content.  What can't be decoded as PCM (compressed audio, other files) has no rows.
    """
    before = (WINDOW // HOP - 1 + WARM_UP) * HOP

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                b = content.as_buffer().to_pybytes() if content.is_valid else b""
                layout = pcm_layout(b)
                if not layout or layout[2] not in (8, 16, 24, 32, 64) or not layout[1] or not layout[0]:
                    continue
                rate, channels, bits, is_float, order, at, size = layout
                width = channels * bits // 8
                n, own = size // width, frames * HOP
                for seg in range(max(1, -(-n // own))):
                    lo, hi = max(0, seg * own - before), min(n, (seg + 1) * own + WINDOW - HOP)
                    x = unpack(b[at + lo * width : at + hi * width], bits, is_float, order, b[:4] == b"RIFF")
                    columns = ([path], [rate], [n], [channels], [seg], [lo], [x])
                    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in SEGMENTS.split(", ")])

    return files.select("path", "content").mapInArrow(cut, SEGMENTS)


WINDOWS = "path string, rate double, window int, x array<float>"


def slow_windows(files: DataFrame, seconds: float = 4) -> DataFrame:
    """Whole windows of each recording, mixed to one channel and thinned to about 1 kHz by averages.

    Every second sample of a group is averaged.  Recordings under two windows have no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                b = content.as_buffer().to_pybytes() if content.is_valid else b""
                layout = pcm_layout(b)
                if not layout or layout[2] not in (8, 16, 24, 32, 64) or not layout[1] or not layout[0]:
                    continue
                rate, channels, bits, is_float, order, at, size = layout
                width = channels * bits // 8
                group = max(1, rate // 1000)
                length = int(rate / group * seconds)
                count = size // width // group // length
                for i in range(count if count >= 2 else 0):
                    lo = at + i * length * group * width
                    x = unpack(b[lo : lo + length * group * width], bits, is_float, order, b[:4] == b"RIFF").reshape(-1, channels)[:, :2].mean(axis=1)
                    x = x.reshape(length, group)[:, ::2].mean(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([rate / group]), pa.array([i], pa.int32()), pa.array([x], pa.list_(pa.float32()))], ["path", "rate", "window", "x"])

    return files.select("path", "content").mapInArrow(cut, WINDOWS)


def wav_bytes(x: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """A WAV file of samples (n, channels): clamped, negatives scaled by 2**(bits - 1), positives by one less.

    16-bit values are truncated toward zero, 24-bit ones rounded down.
    """
    x = np.clip(np.atleast_2d(x.T).T.astype(float), -1, 1)
    top = 2 ** (bits - 1)
    v = np.where(x < 0, x * top, x * (top - 1))
    if bits == 16:
        data = np.trunc(v).astype("<i2").tobytes()
    else:
        data = np.floor(v).astype("<i4").reshape(-1, 1).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    channels = x.shape[1]
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits, b"data", len(data))
    return head + data
