"""Substring dedup over words: difference-cover anchors, then extension to whole windows.

Two equal windows of W words start at i and j.  With D a difference cover modulo v there is a shift
d < v for which (i + d) mod v and (j + d) mod v are both in D, so hashing runs of W - v + 1 words at
cover positions only, |D| / v of all positions, gives every pair of equal windows a common anchor.
Anchors that two documents share point at candidate windows; these are extended to their W words and
compared by a 128-bit hash with the smallest doc_id that has the same window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .common import discard, materialise, shared_keys, squeezed, unsqueeze

WINDOW = 50


@lru_cache
def difference_cover(v: int) -> tuple[int, ...]:
    """A small D with {(a - b) mod v : a, b in D} = {0 .. v - 1}: greedy, then the best of its rotations."""
    if v <= 3:
        return tuple(range(min(v, 2)))
    best: list[int] | None = None

    def grow(chosen: list[int], seen: set[int], limit: int) -> list[int] | None:
        if len(seen) == v:
            return chosen
        if len(chosen) == limit or len(seen) + 2 * sum(range(len(chosen), limit)) < v:
            return None
        gap = next(d for d in range(1, v) if d not in seen)
        for base in chosen:
            for x in ((base + gap) % v, (base - gap) % v):
                if x not in chosen:
                    more = seen | {(x - y) % v for y in chosen} | {(y - x) % v for y in chosen}
                    if found := grow([*chosen, x], more, limit):
                        return found
        return None

    size = 2
    while best is None:
        best = grow([0], {0}, size)
        size += 1
    return tuple(sorted(best))


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """Modulus, cover and anchor length for a window: v of about 5/8 of it leaves anchors long enough to be rare."""
    v = max(1, window * 5 // 8)
    return v, difference_cover(v), window - v + 1


def _scan(texts: pa.Array) -> Iterator[tuple[T.Slice, T.Words, np.ndarray]]:
    for s in T.slices(texts):
        w = T.words(s)
        yield s, w, T.word_hashes(s, w)


def _anchors(w: T.Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, word index and document of the anchors at cover positions."""
    v, cover, length = cover_for(window)
    at, doc = T.whole_windows(w.first, length)
    inside = np.isin(np.arange(v), cover)[(at - w.first[doc]) % v]
    long = (np.diff(w.first) >= window)[doc]
    at, doc = at[inside & long], doc[inside & long]
    return T.window_hashes(h, length)[at] if len(at) else np.zeros(0, np.uint64), at, doc


def _candidates(h: np.ndarray, first: np.ndarray, hit: np.ndarray, window: int) -> np.ndarray:
    """Starts of the whole windows that contain one of the anchors that start at ``hit``."""
    v, _, _ = cover_for(window)
    n = len(h)
    mark = np.zeros(n + 1, np.int64)
    mark[hit] = 1
    total = np.concatenate(([0], np.cumsum(mark)))
    at, _ = T.whole_windows(first, window)
    return at[total[np.minimum(at + v, n)] > total[at]]


def _join_words(s: T.Slice, w: T.Words, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words of each document joined by one space, end to end, with offsets."""
    start, end = w.start[keep], w.end[keep]
    doc = np.repeat(np.arange(len(s.offsets) - 1), np.diff(w.first))[keep]
    length = end - start
    gap = np.ones(len(start), np.int64)
    if len(start):
        gap[np.flatnonzero(np.concatenate((doc[1:] != doc[:-1], [True])))] = 0
    at = np.concatenate(([0], np.cumsum(length + gap)))
    out = np.full(int(at[-1]), 0x20, dtype=np.uint8)
    out[T.ranges(at[:-1], length)] = s.data[T.ranges(start, length)]
    return out.tobytes(), at[np.searchsorted(doc, np.arange(len(s.offsets)))]


def _windows(h: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Both 64-bit hashes of the windows at the given starts."""
    return tuple(T.window_hashes(h, window, b)[start].view(np.int64) if len(start) else np.zeros(0, np.int64) for b in (T.WORD_BASE, T.WORD_BASE_2))


def _one_key(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return T.mix(one.view(np.uint64) ^ T.mix(two.view(np.uint64)))


def _digest(texts: pa.Array, removed: pa.Array | None, window: int, with_text: bool) -> Iterator[tuple[int, int, str | None, str]]:
    """Words, removed words, kept text and its digest; removed: lists of (one, two) of the windows that go."""
    for s in T.slices(texts):
        w = T.words(s)
        n = len(w.start)
        keep = np.ones(n, bool)
        if removed is not None:
            h = T.word_hashes(s, w)
            part = removed[s.row : s.row + len(s.offsets) - 1]
            of = np.repeat(np.arange(len(part)), part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            gone = [part.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(2)]
            at, doc = T.whole_windows(w.first, window)
            starts = at[_pair_in(_one_key(*_windows(h, at, window)), doc, _one_key(*gone), of)]
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, starts, 1)
            np.add.at(step, starts + window, -1)
            keep = np.cumsum(step)[:n] == 0
        out, at = _join_words(s, w, keep)
        words = np.diff(w.first)
        kept = np.concatenate(([0], np.cumsum(keep)))
        left = kept[w.first[1:]] - kept[w.first[:-1]]
        for i in range(len(words)):
            text = out[at[i] : at[i + 1]]
            yield int(words[i]), int(words[i] - left[i]), text.decode() if with_text else None, hashlib.sha256(text).hexdigest()


def dedup_substrings(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts in a smaller doc_id.

    Exact copies are folded into their smallest doc_id first.

    Rows: one per input row, with doc_id, cls (digest of the text), n_words, n_removed, kept_text (kept
    words joined by one space; null when with_text is false) and kept_sha256 of kept_text.

    * null text counts as no words; texts shorter than a window are kept whole;
    * rows with a null doc_id are kept whole and remove nothing (no id is smaller);
    * rows that repeat a doc_id don't remove each other's words, only smaller ids do;
    * equal texts under different ids: the smallest id keeps them;
    * other columns of ``docs`` are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("cls", F.unhex(F.md5("text")))
    owned = base.where("doc_id IS NOT NULL")
    classes = owned.groupBy("cls").agg(F.min("doc_id").alias("owner")).withColumn("tkey", F.xxhash64("cls"))

    def emit(batch: pa.RecordBatch):
        ids = batch.column("tkey").to_numpy()
        for s, w, h in _scan(batch.column("text")):
            keys, _, doc = _anchors(w, h, window)
            yield keys, ids[s.row + doc]

    shared = materialise(shared_keys(owned.select(F.xxhash64("cls").alias("tkey"), "text"), emit).withColumnRenamed("doc_id", "tkey"), "anchors")
    lists = shared.join(classes, "tkey").groupBy("cls", "owner").agg(F.collect_set("key").alias("keys"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in unsqueeze(batch.column("ztext")):
                for s, w, h in _scan(texts):
                    n = len(s.offsets) - 1
                    rows = batch.slice(row + s.row, n)
                    lists = rows.column("keys")
                    keys, at, doc = _anchors(w, h, window)
                    known = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                    hit = at[_pair_in(keys, doc, known, np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False)))]
                    start = _candidates(h, w.first, hit, window)
                    of = np.searchsorted(w.first, start, side="right") - 1
                    one, two = _windows(h, start, window)
                    # A window that a document repeats is told once, so periodic texts don't make hot keys.
                    order = np.lexsort((two, one, of))
                    of, one, two = of[order], one[order], two[order]
                    new = np.ones(len(of), bool)
                    new[1:] = (of[1:] != of[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                    of, one, two = of[new], one[new], two[new]
                    offsets = pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [*(rows.column(c) for c in ("cls", "owner", "ztext")), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (one, two))],
                        ["cls", "owner", "ztext", "one", "two"],
                    )

    packed = squeezed(owned.select("doc_id", "cls", "text"), "doc_id", "cls")
    near = packed.join(lists, "cls").where("doc_id = owner").mapInArrow(extend, "cls binary, owner long, ztext binary, one array<long>, two array<long>")
    near = materialise(near.where("size(one) > 0"), "windows")
    discard(shared)
    each = near.select("cls", "owner", F.explode(F.arrays_zip("one", "two")).alias("w")).select("cls", "owner", "w.*")
    least = each.groupBy("one", "two").agg(F.min("owner").alias("least"), F.max("owner").alias("last")).where("least < last").drop("last")
    removed = each.join(least, ["one", "two"]).where("least < owner")
    removed = materialise(removed.groupBy("cls").agg(F.collect_list(F.struct("one", "two")).alias("gone")), "removed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if "ztext" in batch.schema.names:
                out, parts = [], list(unsqueeze(batch.column("ztext")))
                for row, texts in parts:
                    out += _digest(texts, batch.column("gone").slice(row, len(texts)), window, with_text)
                keys = ["cls"]
            else:
                out, keys = list(_digest(batch.column("text"), None, window, with_text)), ["doc_id", "cls"]
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(c, k) for c, k in zip(columns, kinds))], [*keys, "n_words", "n_removed", "kept_text", "kept_sha256"])

    digest = "n_words long, n_removed long, kept_text string, kept_sha256 string"
    changed = near.select("cls", "ztext").join(removed, "cls")
    changed = changed.mapInArrow(cut, f"cls binary, {digest}").dropDuplicates(["cls"])
    changed = changed.select("cls", *(F.col(c).alias(f"new_{c}") for c in ("n_removed", "kept_text", "kept_sha256")))
    whole = base.select("doc_id", "cls", "text").mapInArrow(cut, f"doc_id long, cls binary, {digest}")
    rows = whole.join(classes.select("cls", "owner"), "cls", "left").join(changed, "cls", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("owner"), F.lit(False)) & (F.col("n_words") >= window)
    cut_here = F.col("new_n_removed").isNotNull() & F.col("doc_id").isNotNull()
    pick = lambda name, gone: F.when(copy, gone).when(cut_here, F.col(f"new_{name}")).otherwise(F.col(name)).alias(name)
    return rows.select(
        "doc_id",
        "cls",
        "n_words",
        pick("n_removed", F.col("n_words")),
        pick("kept_text", F.lit("" if with_text else None).cast("string")),
        pick("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest())),
    )


def _pair_in(keys: np.ndarray, doc: np.ndarray, known: np.ndarray, known_doc: np.ndarray) -> np.ndarray:
    """Whether each (doc, key) is among (known_doc, known)."""
    if not len(known):
        return np.zeros(len(keys), bool)
    mine, theirs = (T.mix(k ^ T.mix(d.astype(np.uint64) + np.uint64(1))) for k, d in ((keys, doc), (known, known_doc)))
    return np.isin(mine, theirs)
