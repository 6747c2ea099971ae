"""Scratch tables in the shared folder, column checks and packed key exchanges."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: Bytes of packed keys that a reducer holds before it folds them into its state.
FOLD_ROWS = 1 << 21
#: Keys that a mapper packs before it hands them to the shuffle.
PACK_ROWS = 1 << 19

#: Has Spark delete the shuffle files of a write when it ends; a session that doesn't know the setting keeps them longer.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_owner: ContextVar[Scratch | None] = ContextVar("owner", default=None)


class Scratch:
    """Owns the scratch tables that are written while it is entered, and only those; ``delete`` removes them.

    Results are lazy, so delete after they are written.  Tables written without an owner go when the driver ends.
    """

    def __init__(self) -> None:
        self.paths: list[str] = []
        self._tokens: list = []

    def __enter__(self) -> Scratch:
        self._tokens.append(_owner.set(self))
        return self

    def __exit__(self, *_) -> None:
        _owner.reset(self._tokens.pop())

    def delete(self, spark: SparkSession) -> None:
        while self.paths:
            delete(spark, self.paths.pop())


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    at, system = _file_system(spark, path)
    system.delete(at, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, a local run (tests) gets a temporary folder of its own, and a cluster an error: a
    folder of one machine would lose what the executors of others write.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, and shuffle files go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    if before is not None:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)
    if (owner := _owner.get()) is not None:
        owner.paths.append(path)
    at, system = _file_system(spark, path)
    system.deleteOnExit(at)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that later steps, all written themselves, no longer read."""
    for t in tables:
        delete(t.sparkSession, t.scratch_path)


def unsent(table: DataFrame) -> DataFrame:
    """table for a join that may not broadcast either side: both are shuffled and merged.

    Spark sizes a table too low after an explode, which it counts as no growth, and by the compressed bytes of its
    files; what it then takes for small is gathered by the driver and held by every executor.
    """
    return table.hint("merge")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def squeezed(docs: DataFrame, *keys: str) -> DataFrame:
    """The keys and ``ztext``, the UTF-8 bytes of text compressed, for a text that must be shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [tool.compress(x.as_buffer() if x.is_valid else b"") for x in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(texts, pa.binary())], [*keys, "ztext"])

    kinds = dict(docs.dtypes)
    return docs.select(*keys, "text").mapInArrow(run, ", ".join([f"{k} {kinds[k]}" for k in keys] + ["ztext binary"]))


def unsqueeze(column: pa.Array, limit: int = 8 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) for runs of rows of about ``limit`` bytes of text."""
    tool, row, held, size = zstandard.ZstdDecompressor(), 0, [], 0
    for i, x in enumerate(column):
        held.append(tool.decompress(x.as_buffer()))
        size += len(held[-1])
        if size >= limit:
            yield row, pa.array(held, pa.binary())
            row, held, size = i + 1, [], 0
    if held:
        yield row, pa.array(held, pa.binary())


PACKED = "bucket int, payload binary"


def pack(keys: np.ndarray, owner: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, payload) of 64-bit keys and the documents that hold them.

    A payload is: number of documents, number of keys, document ids, keys, document index of each key.
    """
    bucket = (keys >> np.uint64(40)) % np.uint64(buckets)
    order = np.lexsort((keys, bucket))
    keys, owner, bucket = keys[order], owner[order], bucket[order].astype(np.int64)
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    names, payloads = [], []
    for lo, hi in zip(edge, [*edge[1:], len(keys)]):
        ids, index = np.unique(owner[lo:hi], return_inverse=True)
        head = np.array([len(ids), hi - lo], dtype=np.int64)
        small = np.uint16 if len(ids) <= 1 << 16 else np.uint32
        payloads.append(b"".join(x.tobytes() for x in (head, ids.astype(np.int64), keys[lo:hi], index.astype(small))))
        names.append(int(bucket[lo]))
    if names:
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n_ids, n = np.frombuffer(payload, np.int64, 2)
    ids = np.frombuffer(payload, np.int64, n_ids, 16)
    keys = np.frombuffer(payload, np.uint64, n, 16 + 8 * n_ids)
    index = np.frombuffer(payload, np.uint16 if n_ids <= 1 << 16 else np.uint32, n, 16 + 8 * n_ids + 8 * n)
    return keys, ids[index]


def packer(emit: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], buckets: int):
    """A mapInArrow function: emit gives (keys, owners) of a batch, distinct pairs are packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            keys, owner = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((owner, keys))
            keys, owner = keys[order], owner[order]
            new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))
            yield from pack(keys[new], owner[new], buckets)

        for batch in batches:
            for keys, owner in emit(batch):
                if len(keys):
                    held.append((keys, owner))
                    size += len(keys)
                if size >= PACK_ROWS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc) pairs whose key is held by two documents at least; rows come bucket by bucket.

    The state has one row for each distinct key of the bucket, however many documents hold it.
    """

    def fold(state, held):
        keys, docs = (np.concatenate(x) for x in zip(*held))
        known = np.concatenate((np.full(len(state[0]), 1, np.int8), np.zeros(len(keys), np.int8)))
        told = np.concatenate((state[2], np.zeros(len(keys), bool)))
        keys, docs = np.concatenate((state[0], keys)), np.concatenate((state[1], docs))
        order = np.lexsort((-known, keys))
        keys, docs, told = keys[order], docs[order], told[order]
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.concatenate((edge, [len(keys)])))
        many = np.minimum.reduceat(docs, edge) < np.maximum.reduceat(docs, edge)
        before = told[edge]
        out = np.repeat(many | before, size) & ~told
        at = np.flatnonzero(out)
        return (keys[edge], docs[edge], many | before), (keys[at], docs[at])

    empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))
    state, held, size, now = empty, [], 0, None

    def rows(found):
        keys, docs = found
        for lo in range(0, len(keys), 1 << 18):
            part = slice(lo, lo + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(docs[part]), pa.array(keys[part].view(np.int64))], ["doc_id", "key"])

    for batch in batches:
        for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
            if bucket != now:
                if held:
                    yield from rows(fold(state, held)[1])
                state, held, size, now = empty, [], 0, bucket
            held.append(unpack(payload.as_py()))
            size += len(held[-1][0])
            if size >= FOLD_ROWS:
                state, found = fold(state, held)
                held, size = [], 0
                yield from rows(found)
    if held:
        yield from rows(fold(state, held)[1])


def shared_keys(docs: DataFrame, emit: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(doc_id, key) for every key that emit finds in two or more documents of docs.

    Keys travel once, packed by bucket; a key that a third of all documents hold takes one row of
    reducer state, and its answers leave the task as a stream.
    """
    n = partitions(docs.sparkSession)
    buckets = 8 * n
    return (
        docs.mapInArrow(packer(emit, buckets), PACKED)
        .repartition(n, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_shared, "doc_id long, key long")
    )


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key as a table, from batches that are sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            key = tuple(c[lo] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)
