"""Byte ranges of files as a data source: for files that a row of Spark's binary reader can't hold, and for parts of any.

``spark.read.format("byte_ranges").load(path)`` gives a row for each piece of each file under a path.  Files are listed
with their lengths on the driver, as Spark's own readers do, and cut into pieces, of which a task reads as many as fit
its share, so that there are no more tasks than bytes need; filters on path, length, extension and start are pushed down,
so that files and pieces that they exclude are never opened.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

from .audio import HOP, SEGMENT_FRAMES, SEGMENTS, WARM_UP, WINDOW, pcm_layout, unpack

SCHEMA = "path string, length bigint, extension string, start bigint, stop bigint, content binary"
#: Bytes of a piece, unless the option ``bytes`` says otherwise.
PIECE = 8 << 20
#: Bytes that a task reads, if pieces are smaller: a share of all, so that few bytes still go to as many tasks, and at most SHARE.
SHARE, TASKS = 32 << 20, 64
#: Pushing filters into Python sources must be switched on.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class File(NamedTuple):
    path: str
    length: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, glob: str | None = None) -> list[File]:
    """Files under a path (a file, a folder or a glob in the last part), hidden ones left out, with their lengths."""
    folder, _, last = path.rpartition("/")
    if glob is None and any(c in last for c in "*?["):
        path, glob = folder, last
    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"
    shown = [x for x in found if x.is_file and not x.base_name.startswith(("_", ".")) and (glob is None or fnmatch.fnmatch(x.base_name, glob))]
    return sorted(File(prefix + x.path, x.size) for x in shown)


def extension(path: str) -> str:
    return path.rpartition("/")[2].rpartition(".")[2].lower()


@dataclass
class Piece(InputPartition):
    """A piece of a file, or a run of pieces that follow each other, and the runs that the same task reads after it."""

    path: str
    length: int
    start: int
    stop: int
    rest: list[Piece] = field(default_factory=list)


def shares(pieces: list[Piece]) -> list[Piece]:
    """Pieces in order of file and start, dealt to tasks; those that follow each other in a task are one run."""
    most = min(SHARE, sum(p.stop - p.start for p in pieces) // TASKS)
    out, held = [], 0
    for p in pieces:
        held += p.stop - p.start
        if not out or held > most:
            out.append(p)
            held = p.stop - p.start
            continue
        run = out[-1].rest[-1] if out[-1].rest else out[-1]
        if run.path == p.path and run.stop == p.start:
            run.stop = p.stop
        else:
            out[-1].rest.append(p)
    return out


def _holds(f: Filter, value) -> bool:
    """Whether a pushed filter holds for a value of its column; rows have no nulls there."""
    v = f.value
    if isinstance(f, In):
        return value in v
    if isinstance(f, (StringStartsWith, StringEndsWith)):
        return value.startswith(v) if isinstance(f, StringStartsWith) else value.endswith(v)
    tests = {EqualTo: value == v, GreaterThan: value > v, GreaterThanOrEqual: value >= v, LessThan: value < v, LessThanOrEqual: value <= v}
    return tests[type(f)]


class RangeReader(DataSourceReader):
    """Pieces of ``bytes`` bytes; ``first`` and ``last`` (both included) cut a range out of each file."""

    KNOWN = (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In, StringStartsWith, StringEndsWith)

    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("pathglobfilter")
        self.bytes = int(options.get("bytes", PIECE))
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", 2**62))
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, self.KNOWN) and f.attribute in (("path",), ("length",), ("extension",), ("start",)):
                self.pushed.append(f)
            else:
                yield f

    def partitions(self) -> list[Piece]:
        fits = lambda name, value: all(_holds(f, value) for f in self.pushed if f.attribute == (name,))
        out = []
        for path, length in listed(self.path, self.glob):
            if fits("path", path) and fits("length", length) and fits("extension", extension(path)):
                end = min(length, self.last + 1)
                out += [Piece(path, length, at, min(at + self.bytes, end)) for at in range(self.first, end, self.bytes) if fits("start", at)]
        # A source without partitions would be given one that means nothing.
        return shares(out) or [Piece("", 0, 0, 0)]

    def read(self, piece: Piece) -> Iterator[tuple]:
        for run in (piece, *piece.rest) if piece.path else ():
            system, inner = _opened(run.path)
            with system.open_input_file(inner) as file:
                for at in range(run.start, run.stop, self.bytes):
                    stop = min(at + self.bytes, run.stop)
                    yield run.path, run.length, extension(run.path), at, stop, file.read_at(stop - at, at)


class ByteRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


def byte_ranges(spark: SparkSession, path: str, piece: int = PIECE, glob: str | None = None, first: int = 0, last: int | None = None) -> DataFrame:
    """Pieces (SCHEMA) of the files under a path; filters on path, length, extension and start prune them.

    Empty files, and files that end before ``first``, have no pieces; ``answer`` tells their status.
    """
    spark.dataSource.register(ByteRanges)
    spark.conf.set(PUSHDOWN, "true")
    reader = spark.read.format("byte_ranges").option("bytes", str(piece)).option("first", str(first))
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return (reader.option("last", str(last)) if last is not None else reader).load(path)


def answer(length: Column, first: Column, last: Column) -> Column:
    """struct(status, first, last, told) for a request of the bytes first .. last (null: from or to the end).

    200: no range; 206: the part that there is, and its Content-Range; 416: the range starts past the end or is empty.
    A null first asks for the last ``last`` bytes.
    """
    n = length.cast("bigint")
    lo = F.when(first.isNull(), F.greatest(F.lit(0), n - last)).otherwise(first)
    hi = F.when(first.isNull() | last.isNull(), n - 1).otherwise(F.least(last, n - 1))
    whole, wrong = first.isNull() & last.isNull(), (lo >= n) | (lo > hi) | (first.isNull() & (last <= 0))
    text = F.concat(F.lit("bytes "), lo.cast("string"), F.lit("-"), hi.cast("string"), F.lit("/"), n.cast("string"))
    return (
        F.when(whole, F.struct(F.lit(200).alias("status"), F.lit(0).cast("bigint").alias("first"), (n - 1).alias("last"), F.lit(None).cast("string").alias("told")))
        .when(wrong, F.struct(F.lit(416).alias("status"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("last"), F.concat(F.lit("bytes */"), n.cast("string")).alias("told")))
        .otherwise(F.struct(F.lit(206).alias("status"), lo.alias("first"), hi.alias("last"), text.alias("told")))
    )


#: Bytes at the start of a file in which the layout of its samples is looked for.
HEAD = 1 << 20

LAYOUTS = "path string, length bigint, sample_rate int, channels int, bits int, is_float boolean, byte_order string, riff boolean, data_at bigint, data_bytes bigint, n_samples bigint"


def layouts(pieces: DataFrame) -> DataFrame:
    """How the samples of PCM files lie, from their first pieces: LAYOUTS.  Files whose sizes pass 4 GiB say 0 or all ones;
    their samples go to the end of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, content in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), batch.column("content")):
                found = pcm_layout(content.as_py(), length)
                if found and found[2] in (8, 16, 24, 32, 64) and found[0] and found[1]:
                    rate, channels, bits, is_float, order, at, size = found
                    row = (path, length, rate, channels, bits, is_float, order, content.as_py()[:4] == b"RIFF", at, size, size // (channels * bits // 8))
                    yield pa.RecordBatch.from_arrays([pa.array([x]) if i not in (2, 3, 4) else pa.array([x], pa.int32()) for i, x in enumerate(row)], [c.split()[0] for c in LAYOUTS.split(", ")])

    return pieces.where("start = 0").select("path", "length", "content").mapInArrow(run, LAYOUTS)


def pcm_segments(spark: SparkSession, path: str, glob: str | None = None, frames: int = SEGMENT_FRAMES) -> DataFrame:
    """Rows of sources.audio.segments for PCM files of any size: each segment reads its own bytes and its halo.

    Only layouts are made from the heads of the files; a task holds one segment at a time.
    """
    found = layouts(byte_ranges(spark, path, HEAD, glob, 0, HEAD - 1))
    own, before = frames * HOP, (WINDOW // HOP - 1 + WARM_UP) * HOP
    count = F.greatest(F.lit(1), F.ceil(F.col("n_samples") / own)).cast("int")
    segs = found.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("seg")).repartition(max(1, spark.sparkContext.defaultParallelism), "path", "seg")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                width = r["channels"] * r["bits"] // 8
                lo, hi = max(0, r["seg"] * own - before), min(r["n_samples"], (r["seg"] + 1) * own + WINDOW - HOP)
                system, inner = _opened(r["path"])
                with system.open_input_file(inner) as file:
                    b = file.read_at((hi - lo) * width, r["data_at"] + lo * width)
                x = unpack(b, r["bits"], r["is_float"], r["byte_order"], r["riff"]).astype(np.float32)
                row = ([r["path"]], [r["sample_rate"]], [r["n_samples"]], [r["channels"]], [r["seg"]], [lo], [x])
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], [c.split()[0] for c in SEGMENTS.split(", ")])

    return segs.mapInArrow(cut, SEGMENTS)
