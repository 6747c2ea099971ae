"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of shingles into powers of two.  For each partition, documents
are read as overlapping pieces of twice its size, so an item of q shingles meets a piece of fewer than 4 q
and a contained item has a Jaccard similarity of at least 0.8 / 4.2 with it; one of HASHES minima agrees
but for a chance of (1 - 0.19) ** 64, about 1e-6.  An item that is spread over a document is found as well: piece
j, with a share c_j of its q shingles, has a similarity of c_j q / (q + 4 q) at least, these sum to 0.8 / 5 however
the item is spread, and all pieces miss it with a chance under exp(-0.16 * 64), 4e-5.  What agrees is verified
exactly: the share of the item's shingles that the whole document has.  Documents are scanned where they lie,
nothing is shuffled but hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T

SHINGLE, THRESHOLD, HASHES = 5, (4, 5), 64
#: Items, and bytes of their texts, that one pass over the documents looks for; more of them take more passes.
ITEMS_A_PASS, BYTES_A_PASS = 50_000, 64 << 20

_SEEDS = T.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xB5297A4D3F84D5B5)) | np.uint64(1)


def _minhash(h: np.ndarray, j: int) -> np.ndarray:
    x = h * _SEEDS[j]
    x ^= x >> np.uint64(32)
    return x * np.uint64(0x9E6C63D0876A9A47)


class Index:
    """Shingles of items, and for each size partition the minima of its items, sorted for every hash."""

    def __init__(self, ids: list[int], texts: list[str | None], shingle: int):
        s = next(T.slices(pa.array(texts, pa.string()), 1 << 40))
        w = T.words(s)
        long = np.diff(w.first) >= shingle
        h, doc = T.shingles(T.word_hashes(s, w), w.first, shingle)
        first = np.searchsorted(doc, np.arange(len(ids) + 1))
        self.ids, self.sets, parts = [], [], {}
        for i in np.flatnonzero(long):
            q = np.unique(h[first[i] : first[i + 1]])
            stride = 1 << int(len(q) - 1).bit_length()
            parts.setdefault(stride, []).append(len(self.sets))
            self.ids.append(ids[i])
            self.sets.append(q)
        self.parts = {}
        for stride, items in sorted(parts.items()):
            together = np.concatenate([self.sets[i] for i in items])
            start = np.cumsum([0] + [len(self.sets[i]) for i in items[:-1]])
            minima = np.stack([np.minimum.reduceat(_minhash(together, j), start) for j in range(HASHES)], axis=1)
            order = np.argsort(minima, axis=0)
            self.parts[stride] = (np.take_along_axis(minima, order, axis=0), np.array(items)[order])


def _candidates(index: Index, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(document, item) pairs that agree in a minimum of some piece."""
    found = []
    count = np.diff(first)
    grids = {}
    for stride in index.parts:
        blocks = -(-count // stride)
        owner = np.repeat(np.arange(len(count)), blocks)
        start = np.repeat(first[:-1], blocks) + T.ranges(np.zeros(len(blocks), np.int64), blocks) * stride
        grids[stride] = owner, start
    if not len(h):
        return np.zeros((0, 2), np.int64)
    for j in range(HASHES):
        x = _minhash(h, j)
        for stride, (owner, start) in grids.items():
            low = np.minimum.reduceat(x, start)
            piece = low.copy()
            same = owner[1:] == owner[:-1]
            piece[:-1][same] = np.minimum(low[:-1], low[1:])[same]
            values, items = index.parts[stride][0][:, j], index.parts[stride][1][:, j]
            a = np.searchsorted(values, piece)
            b = np.searchsorted(values, piece, side="right")
            hit = np.flatnonzero(b > a)
            if len(hit):
                n = b[hit] - a[hit]
                found.append(np.stack((np.repeat(owner[hit], n), items[T.ranges(a[hit], n)]), axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _search(docs: DataFrame, index: Index, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)  # about ITEMS_A_PASS items and BYTES_A_PASS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("text_key").to_numpy()
            out: list[tuple[int, ...]] = []
            for s in T.slices(batch.column("text")):
                w = T.words(s)
                h, doc = T.shingles(T.word_hashes(s, w), w.first, shingle)
                first = np.searchsorted(doc, np.arange(len(s.offsets)))
                now, own = -1, None
                for d, i in _candidates(index, h, first).tolist():
                    if d != now:
                        now, own = d, np.unique(h[first[d] : first[d + 1]])
                    q = index.sets[i]
                    at = np.minimum(np.searchsorted(own, q), len(own) - 1)
                    hits = int(np.count_nonzero(own[at] == q))
                    if threshold[1] * hits >= threshold[0] * len(q):
                        out.append((int(ids[s.row + d]), int(keys[s.row + d]), index.ids[i], hits, len(q)))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "text_key", "item_id", "n_hits", "n_shingles"])

    return docs.mapInArrow(run, HITS)


HITS = "doc_id long, text_key long, item_id long, n_hits long, n_shingles long"


def contaminated(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, by_text: bool = False) -> DataFrame:
    """Documents that contain four fifths at least of the five-word shingles of a test item.

    Rows: one for each such pair, with doc_id, item_id, n_hits (distinct shingles of the item that the whole
    document has), n_shingles (of the item) and containment.  Clean documents have no row.

    * items and documents under five words have no shingles of five words and match nothing;
    * null texts and null ids match nothing; rows that repeat an id pair give one row, the best, or with ``by_text``
      one for each text (text_key, its xxhash64);
    * other columns are not read; empty tables give an empty result.
    """
    own = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    wanted = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    n, size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-n // ITEMS_A_PASS), -(-size // BYTES_A_PASS))
    found = None
    for k in range(passes):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect() if passes > 1 else wanted.collect()
        part = _search(own, Index([r.item_id for r in rows], [r.text for r in rows], shingle), shingle, threshold) if rows else None
        found = part if found is None else found if part is None else found.union(part)
    if found is None:
        found = own.sparkSession.createDataFrame([], HITS)
    keys = ["doc_id", "text_key", "item_id"] if by_text else ["doc_id", "item_id"]
    best = found.groupBy(*keys).agg(F.max_by(F.struct("n_hits", "n_shingles"), F.col("n_hits") / F.col("n_shingles")).alias("b"))
    return best.select(*keys, "b.n_hits", "b.n_shingles", (F.col("b.n_hits") / F.col("b.n_shingles")).alias("containment"))


#: DuckDB form over the tables documents and benchmark.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bp AS (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM bp),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM dp),
q AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
h AS (SELECT doc_id, item_id, count(*) AS n_hits FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n_hits AS BIGINT) AS n_hits, CAST(n_shingles AS BIGINT) AS n_shingles,
       CAST(n_hits AS DOUBLE) / CAST(n_shingles AS DOUBLE) AS containment
FROM h JOIN q USING (item_id) WHERE 5 * n_hits >= 4 * n_shingles
"""
