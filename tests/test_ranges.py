"""Byte ranges of files: pieces, pushed filters, answers to range requests, and sound that is larger than memory."""

from __future__ import annotations

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from refract.sources import audio, ranges
from refract.sources.ranges import answer, byte_ranges, layouts, listed, pcm_segments


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    (at / "sub").mkdir()
    for name, n in (("a.bin", 1000), ("b.TXT", 10), ("sub/c.bin", 2500), ("empty.bin", 0), (".hidden", 5), ("_SUCCESS", 5)):
        (at / name).write_bytes(bytes(i * 7 % 251 for i in range(n)))
    return at


def test_pieces_make_the_files(spark, folder):
    rows = byte_ranges(spark, str(folder), 300).collect()
    whole = {}
    for r in sorted(rows, key=lambda r: (r.path, r.start)):
        assert r.stop - r.start == len(r.content) and r.start == len(whole.get(r.path, b""))
        whole[r.path] = whole.get(r.path, b"") + bytes(r.content)
    assert {os.path.relpath(p, folder): len(b) for p, b in whole.items()} == {"a.bin": 1000, "b.TXT": 10, "sub/c.bin": 2500}
    assert all(b == open(p, "rb").read() for p, b in whole.items())
    assert len(byte_ranges(spark, f"file://{folder}", 300).collect()) == len(rows)
    assert [r.extension for r in byte_ranges(spark, str(folder / "*.TXT")).collect()] == ["txt"]
    assert bytes(byte_ranges(spark, str(folder / "a.bin"), first=10, last=19).first().content) == open(folder / "a.bin", "rb").read()[10:20]
    assert byte_ranges(spark, str(folder / "empty.bin")).count() == 0


def test_filters_prune_pieces(spark, folder, monkeypatch):
    """What filters exclude is never opened; filters on the bytes stay with Spark."""
    df = byte_ranges(spark, str(folder), 300)
    for keep, want in (
        (F.col("path").endswith("a.bin"), 4), (F.col("length") > 1000, 9), (F.col("extension") == "txt", 1), (F.col("start").between(300, 899), 4), (F.col("extension").isin("txt", "gz"), 1),
        (F.col("length") < 5, 0), ((F.col("start") == 0) & (F.octet_length("content") == 300), 2),
    ):
        assert df.where(keep).count() == want
    reader = ranges.RangeReader({"path": str(folder), "bytes": "300"})
    from pyspark.sql.datasource import EqualTo, IsNotNull, LessThan

    left = list(reader.pushFilters([EqualTo(("extension",), "bin"), LessThan(("start",), 600), IsNotNull(("path",)), EqualTo(("content",), b"")]))
    assert len(left) == 2 and [(p.length, p.start) for p in reader.partitions()] == [(1000, 0), (1000, 300), (2500, 0), (2500, 300)]


def test_tasks_grow_with_bytes_not_with_pieces(spark, tmp_path, monkeypatch):
    """Many small pieces, and many small files, share tasks; each piece comes once, also where a filter leaves gaps."""
    data = bytes(i * 7 % 251 for i in range(100_003))
    (tmp_path / "a.bin").write_bytes(data)
    for i in range(300):
        (tmp_path / f"b{i}.bin").write_bytes(data[: i + 1])
    df = byte_ranges(spark, str(tmp_path), 64)
    assert df.rdd.getNumPartitions() <= 2 * ranges.TASKS
    rows = sorted(df.collect(), key=lambda r: (r.path, r.start))
    assert all(r.stop - r.start == len(r.content) <= 64 and r.start % 64 == 0 and r.length == os.path.getsize(r.path) for r in rows)
    assert b"".join(bytes(r.content) for r in rows if r.path.endswith("/a.bin")) == data and len(rows) == 1563 + sum(-(-(i + 1) // 64) for i in range(300))
    few = df.where(F.col("start").isin(0, 64, 192, 99_968)).select("path", "start", F.octet_length("content").alias("n")).collect()
    assert sorted((r.start, r.n) for r in few if r.path.endswith("/a.bin")) == [(0, 64), (64, 64), (192, 64), (99_968, 35)]
    assert len(few) == 4 + 300 + 236 + 108
    monkeypatch.setattr(ranges, "SHARE", 1000)
    assert all(p.stop - p.start + sum(x.stop - x.start for x in p.rest) <= 1000 for p in ranges.RangeReader({"path": str(tmp_path), "bytes": "64"}).partitions())


def test_missing_paths(folder):
    with pytest.raises(FileNotFoundError):
        listed(str(folder / "nothing"))


def test_answers(spark):
    cases = [
        (100, 0, 9, (206, 0, 9, "bytes 0-9/100")), (100, 90, 200, (206, 90, 99, "bytes 90-99/100")), (100, 50, None, (206, 50, 99, "bytes 50-99/100")), (100, None, 10, (206, 90, 99, "bytes 90-99/100")),
        (100, None, 500, (206, 0, 99, "bytes 0-99/100")), (100, None, None, (200, 0, 99, None)), (100, 100, 120, (416, None, None, "bytes */100")), (100, 5, 4, (416, None, None, "bytes */100")), (0, 0, 0, (416, None, None, "bytes */0")),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "n bigint, a bigint, b bigint")
    got = [tuple(r.x) for r in df.select(answer(F.col("n"), F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [c[3] for c in cases]


def wave(n_bytes: int, rate: int, channels: int, size: int) -> bytes:
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", size, b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", n_bytes)


def test_segments_equal_those_of_whole_files(spark, tmp_path):
    x = np.random.default_rng(1).uniform(-1, 1, (40_000, 2))
    (tmp_path / "a.wav").write_bytes(audio.wav_bytes(x, 8000))
    (tmp_path / "b.wav").write_bytes(audio.wav_bytes(x[:100, 0], 16000))
    (tmp_path / "c.wav").write_bytes(b"not sound")
    files = spark.read.format("binaryFile").load(str(tmp_path)).withColumn("path", F.substring_index("path", "/", -1))
    rows = lambda df: sorted((r.path.rpartition("/")[2], r.seg, r.sample_rate, r.n_samples, r.channels, r.start, tuple(r.samples)) for r in df.collect())
    assert rows(pcm_segments(spark, str(tmp_path), "*.wav", 20)) == rows(audio.segments(files, 20))


def test_sparse_file_of_three_gigabytes(spark, tmp_path):
    """Its layout and single segments come without the rest of it; sizes that don't fit 32 bits go to the end."""
    path, n = tmp_path / "long.wav", 3 << 30
    with open(path, "wb") as f:
        f.write(wave(n, 48_000, 2, 0xFFFFFFFF))
        f.seek(44 + n // 2)
        f.write(struct.pack("<hh", 16_384, -16_384))
        f.truncate(44 + n)
    found = layouts(byte_ranges(spark, str(path), 1 << 16, last=(1 << 16) - 1)).first()
    assert (found.sample_rate, found.channels, found.bits, found.data_at, found.n_samples) == (48_000, 2, 16, 44, n // 4)
    at = n // 8
    seg = at // (audio.SEGMENT_FRAMES * audio.HOP)
    few = pcm_segments(spark, str(path)).where(F.col("seg") == seg).select("start", F.array_position(F.transform("samples", lambda v: v != 0), True).alias("first"), F.array_max("samples").alias("top")).first()
    assert few.top == 0.5 and few.start + (few.first - 1) // 2 == at
    assert byte_ranges(spark, str(path), 1 << 20).where("start >= 3221225000").count() == 1
