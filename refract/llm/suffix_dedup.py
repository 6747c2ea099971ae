"""Suffix-array dedup over bytes: induced sorting of sampled suffixes with common-prefix values.

The suffixes that matter are those whose first W bytes occur elsewhere.  They are sorted the way
induced sorting does it: first the suffixes at *sampled* positions (local minima of a gram rank, which
play the part of the left-most-S positions and are the same in equal strings), then every other suffix
from the sampled one to its right, one preceding byte at a time.  Each step is a stable sort by that
byte, and the common prefix of two neighbours is one more than the minimum over the range between
their followers, so suffix tuples carry their common-prefix values along and nothing is compared twice.

The queues between the steps are Spark's: sampled positions travel to a reducer by gram (packed), tuples
(gram, context, owner) are pre-aggregated and sorted on disk by Spark's external sort, and a task only
holds one run of gram groups at a time.  A gram with very many different contexts would be a run without a bound;
its windows are compared by their hashes in a grouped minimum and a join instead, which hold no group.  Exact
copies are folded into their smallest doc_id before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .common import discard, materialise, partitions, shared_keys, squeezed, unsqueeze

WINDOW, GRAM = 50, 24
#: Tuples that an induction step holds before the next gram group starts a new run.
RUN_ROWS = 1 << 17
#: Different contexts of a gram from which they aren't brought to one task, and the most grams that are broadcast.
HEAVY_ROWS, BROADCAST_GRAMS = 1 << 17, 1 << 20
SECOND_BASE = 0xD1B54A32D192ED03


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def sample(s: T.Slice, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions, gram hash at every position, least gram hash of every window (0: no whole window)."""
    n, reach = len(s.data), window - gram + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none.astype(np.uint64), none.astype(np.uint64)
    up, down = T.powers(T.BYTE_BASE, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(T._BYTE[s.data] * up, out=total[1:])
    rank = T.mix((total[gram:] - total[: n - gram + 1]) * down[: n - gram + 1]) | np.uint64(1)
    least = _slide(rank, reach, np.minimum)
    step = np.zeros(n + 1, np.int64)
    long = np.diff(s.offsets) >= window
    np.add.at(step, s.offsets[:-1][long], 1)
    np.add.at(step, s.offsets[1:][long] - window + 1, -1)
    least = np.where(np.cumsum(step)[: len(least)] > 0, least, np.uint64(0))
    edge = np.zeros(reach - 1, np.uint64)
    most = _slide(np.concatenate((edge, least, edge)), reach, np.maximum)
    return np.flatnonzero(most[: len(rank)] == rank), rank, least


def designated(at: np.ndarray, rank: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every whole window, its start and the index in ``at`` of its left-most least gram."""
    start = np.flatnonzero(least)
    index = np.searchsorted(at, start)
    todo = np.flatnonzero(rank[at[index]] != least[start]) if len(start) else start
    while len(todo):
        index[todo] += 1
        todo = todo[rank[at[index[todo]]] != least[start[todo]]]
    return start, index


def digests(context: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each tuple: its context and the windows it stands for."""
    bounds = T.mix((near.astype(np.int64) * 64 + far).astype(np.uint64) + np.uint64(77))
    out = []
    for base in (T.BYTE_BASE, SECOND_BASE):
        total = np.zeros(len(context), np.uint64)
        for column, power in zip(context.T, T.powers(base, context.shape[1])[0]):
            total += T._BYTE[column] * power
        out.append(T.mix(total + bounds).view(np.int64))
    return out[0], out[1]


def tuples(s: T.Slice, shared: np.ndarray, shared_doc: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray] | None:
    """Sampled positions whose gram another text holds: windows they stand for, and their context bytes."""
    at, rank, least = sample(s, window, gram)
    if not len(at) or not len(shared):
        return None
    start, index = designated(at, rank, least)
    lo, last = np.flatnonzero(np.diff(index, prepend=-1)), np.flatnonzero(np.diff(index, append=-1))
    at, first, final = at[index[lo]], start[lo], start[last]
    doc = np.searchsorted(s.offsets, at, side="right") - 1
    mine = T.mix(rank[at] ^ T.mix(doc.astype(np.uint64) + np.uint64(1)))
    pick = np.isin(mine, T.mix(shared ^ T.mix(shared_doc.astype(np.uint64) + np.uint64(1))))
    if not pick.any():
        return None
    at, first, final, doc = at[pick], first[pick], final[pick], doc[pick]
    near, far = at - final, at - first  # windows start near .. far bytes before the sampled position
    left, right = first, final + window
    reach = window - gram
    column = np.arange(-reach, window)
    place = at[:, None] + column
    context = np.where((place >= left[:, None]) & (place < right[:, None]), s.data[np.clip(place, 0, len(s.data) - 1)], 0).astype(np.uint8)
    bounds = (near * 64 + far).astype(np.uint64)
    out = {"doc": doc, "at": at - s.offsets[doc], "near": near, "far": far, "gram": rank[at], "context": context}
    return out


def induce(group: np.ndarray, context: np.ndarray, near: np.ndarray, far: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For every tuple a bit mask: bit l if its window l bytes before the sample starts in a smaller owner's text.

    group: tuples are only compared within it.  context: reach bytes before the sample, then window bytes.
    """
    reach = context.shape[1] - window
    mask = np.zeros(len(group), np.int64)
    right = context[:, reach:]
    head = group.astype(">u4").view(np.uint8).reshape(-1, 4)
    order = np.argsort(np.ascontiguousarray(np.concatenate((head, right), axis=1)).view(f"S{4 + window}").ravel(), kind="stable")
    same = right[order[1:]] == right[order[:-1]]
    common = np.where(same.all(axis=1), window, same.argmin(axis=1))
    common[group[order[1:]] != group[order[:-1]]] = 0
    common = np.concatenate(([0], common)).astype(np.int32)
    for level in range(reach + 1):
        if not len(order):
            break
        edge = np.flatnonzero(common < window)
        live = (near[order] <= level) & (level <= far[order])
        low = np.minimum.reduceat(np.where(live, owner[order], np.iinfo(np.int64).max), edge)
        smaller = live & (np.repeat(low, np.diff(np.append(edge, len(order)))) < owner[order])
        mask[order[smaller]] |= np.int64(1) << level
        if level == reach:
            break
        # Tuples that can't reach a common prefix of a window any more leave the queue.
        need = window - (reach - level)
        keep = (np.maximum(common, np.append(common[1:], 0)) >= need) & (far[order] > level)
        at = np.flatnonzero(keep)
        if not len(at):
            break
        common = np.minimum.reduceat(common[: at[-1] + 1], np.concatenate(([0], at[:-1] + 1)))
        order = order[at]
        common[0] = 0
        key = group[order].astype(np.int64) * 256 + context[order, reach - 1 - level]
        place = np.argsort(key, kind="stable")
        new = np.zeros(len(place), np.int32)
        pair = np.flatnonzero(key[place[1:]] == key[place[:-1]])
        if len(pair):
            lo, hi = place[pair] + 1, place[pair + 1] + 1
            padded = np.append(common, np.int32(0))
            ends = np.stack((lo, hi), axis=1).ravel()
            new[pair + 1] = 1 + np.minimum.reduceat(padded, ends)[::2]
        order, common = order[place], new
    return mask


def _runs(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Induction over whole gram groups; rows come sorted by gram."""
    width = 2 * window - gram

    def solve(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        context = np.frombuffer(t["context"].combine_chunks().cast(pa.binary(width)).buffers()[1], np.uint8)[: width * len(t)].reshape(-1, width)
        grams, near, far, owner, last = (t[c].to_numpy() for c in ("gram", "near", "far", "owner", "last"))
        group = np.unique(grams, return_inverse=True)[1]
        mask = induce(group, context, near, far, owner, window)
        told = np.flatnonzero((mask != 0) | (last > owner))
        one, two = digests(context[told], near[told], far[told])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (one, two, owner[told], mask[told])], ["one", "two", "least", "mask"])

    held, size = [], 0
    for batch in batches:
        if size >= RUN_ROWS and batch.num_rows:
            last = held[-1]["gram"][-1].as_py()
            cut = int(np.searchsorted(batch["gram"].to_numpy(), last, side="right"))
            if cut < batch.num_rows:
                yield solve([*held, batch.slice(0, cut)] if cut else held)
                held, size, batch = [], 0, batch.slice(cut)
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
    if held:
        yield solve(held)


def _heavy(queue: DataFrame, window: int, gram: int) -> DataFrame:
    """What _runs gives, for tuples of grams with very many contexts: every window is a row."""
    reach, width = window - gram, 2 * window - gram

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                context = np.frombuffer(b"".join(x.as_py() for x in batch.column("context")), np.uint8).reshape(-1, width)
                grams, near, far, owner = (batch.column(c).to_numpy() for c in ("gram", "near", "far", "owner"))
                mine = digests(context, near, far)
                for level in range(reach + 1):
                    on = np.flatnonzero((near <= level) & (level <= far))
                    one, two = digests(context[on, reach - level : reach - level + window], np.full(len(on), level), grams[on])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one, two, owner[on], np.full(len(on), level), mine[0][on], mine[1][on])], ["w1", "w2", "owner", "level", "one", "two"])

    windows = materialise(queue.mapInArrow(expand, "w1 long, w2 long, owner long, level long, one long, two long"), "heavy")
    least = windows.groupBy("w1", "w2").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).where("low < high").select("w1", "w2", "low")
    hit = windows.join(least, ["w1", "w2"]).where("low < owner").select("one", "two", F.expr("shiftleft(1L, CAST(level AS INT))").alias("bit"))
    masks = hit.groupBy("one", "two").agg(F.bit_or("bit").alias("mask"))
    told = windows.groupBy("one", "two").agg(F.min("owner").alias("least"))
    return told.join(masks, ["one", "two"], "left").select("one", "two", "least", F.coalesce("mask", F.lit(0)).cast("long").alias("mask"))


def dedup_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Remove every byte covered by a ``window``-byte string that also starts in a smaller doc_id.

    Rows: one per input row, with doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the
    remaining bytes; null when with_text is false) and kept_sha256.

    * null text counts as empty; texts under ``window`` bytes are kept whole;
    * rows with a null doc_id are kept whole and remove nothing;
    * rows that repeat a doc_id are judged against smaller ids only;
    * exact copies of a text of ``window`` bytes or more under a larger id lose all bytes;
    * other columns of ``docs`` are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    reach = window - gram
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("cls", F.unhex(F.md5("text")))
    long = base.where(f"octet_length(text) >= {window} AND doc_id IS NOT NULL")
    classes = long.groupBy("cls").agg(F.min("doc_id").alias("owner")).withColumn("tkey", F.xxhash64("cls"))

    def emit(batch: pa.RecordBatch):
        ids = batch.column("tkey").to_numpy()
        for s in T.slices(batch.column("text")):
            at, rank, _ = sample(s, window, gram)
            yield rank[at], ids[s.row + np.searchsorted(s.offsets, at, side="right") - 1]

    shared = materialise(shared_keys(long.select(F.xxhash64("cls").alias("tkey"), "text"), emit).withColumnRenamed("doc_id", "tkey"), "shared")
    lists = shared.join(classes, "tkey").groupBy("cls", "owner").agg(F.collect_set("key").alias("keys"))
    packed = squeezed(long.select("doc_id", "cls", "text"), "doc_id", "cls")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in unsqueeze(batch.column("ztext")):
                for s in T.slices(texts):
                    n = len(s.offsets) - 1
                    part = batch.slice(row + s.row, n)
                    keys = part.column("keys")
                    known = keys.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                    found = tuples(s, known, np.repeat(np.arange(n), keys.value_lengths().to_numpy(zero_copy_only=False)), window, gram)
                    if found is None:
                        continue
                    doc, context = pa.array(found["doc"]), found["context"]
                    m, width = context.shape
                    bytes_ = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.arange(0, (m + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(context))])
                    one, two = digests(context, found["near"], found["far"])
                    number = lambda c, kind: pa.array(found[c].astype(kind))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("cls").take(doc), part.column("owner").take(doc), number("at", np.int32), number("near", np.int32), number("far", np.int32), pa.array(found["gram"].view(np.int64)), pa.array(one), pa.array(two), bytes_],
                        ["cls", "owner", "at", "near", "far", "gram", "one", "two", "context"],
                    )

    spots = materialise(
        packed.join(lists, "cls").where("doc_id = owner").mapInArrow(extend, "cls binary, owner long, at int, near int, far int, gram long, one long, two long, context binary"), "spots"
    )
    discard(shared)
    queue = spots.groupBy("gram", "near", "far", "context").agg(F.min("owner").alias("owner"), F.max("owner").alias("last"))
    queue = materialise(queue, "queue")
    heavy = materialise(queue.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy_rows).select("gram"), "grams")
    n_heavy = heavy.count()
    some = F.broadcast(heavy) if n_heavy <= BROADCAST_GRAMS else heavy
    rest = queue.join(some, "gram", "left_anti") if n_heavy else queue
    rest = rest.repartition(partitions(spark), "gram").sortWithinPartitions("gram")
    solved = rest.mapInArrow(lambda it: _runs(it, window, gram), "one long, two long, least long, mask long")
    if n_heavy:
        solved = solved.unionByName(_heavy(queue.join(some, "gram", "left_semi"), window, gram))
    solved = materialise(solved, "solved")
    discard(queue, heavy)
    full = (1 << (reach + 1)) - 1
    hits = (
        spots.select("cls", "owner", "at", "near", "far", "one", "two").join(solved, ["one", "two"])
        .withColumn("bits", F.when(F.col("owner") > F.col("least"), F.lit(full)).otherwise(F.col("mask")))
        .where("bits <> 0")
    )
    spans = materialise(hits.groupBy("cls").agg(F.collect_set(F.struct("at", "near", "far", "bits")).alias("hits")), "spans")

    discard(spots, solved)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for z, hits in zip(batch.column("ztext"), batch.column("hits")):
                data = np.frombuffer(next(unsqueeze(pa.array([z.as_py()], pa.binary())))[1][0].as_buffer(), np.uint8)
                at, near, far, bits = (hits.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
                step = np.zeros(len(data) + 1, np.int64)
                for level in range(reach + 1):
                    on = ((bits >> level) & 1 == 1) & (near <= level) & (level <= far)
                    np.add.at(step, at[on] - level, 1)
                    np.add.at(step, at[on] - level + window, -1)
                gone = np.cumsum(step)[:-1] > 0
                kept = data[~gone].tobytes()
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
                out.append((int(gone.sum()), runs, kept if with_text else None, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("cls"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["cls", "cut_removed", "cut_spans", "cut_kept", "cut_sha"])

    changed = packed.join(spans, "cls").join(classes.select("cls", "owner"), "cls").where("doc_id = owner").select("cls", "ztext", "hits")
    changed = changed.mapInArrow(cut, "cls binary, cut_removed long, cut_spans long, cut_kept binary, cut_sha string").dropDuplicates(["cls"])
    rows = base.select("doc_id", "cls", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), *([F.col("text").cast("binary").alias("text")] if with_text else []))
    rows = rows.join(classes.select("cls", "owner"), "cls", "left").join(changed, "cls", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("owner"), F.lit(False))
    cut_here = F.col("cut_removed").isNotNull() & F.col("doc_id").isNotNull()
    zero = F.lit(0).cast("long")
    pick = lambda all_, some, none: F.when(copy, all_).when(cut_here, some).otherwise(none)
    return rows.select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), F.col("cut_removed"), zero).alias("n_removed"),
        pick(F.lit(1).cast("long"), F.col("cut_spans"), zero).alias("n_spans"),
        pick(F.lit(b""), F.col("cut_kept"), F.col("text") if with_text else F.lit(None).cast("binary")).alias("kept"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("cut_sha"), F.col("sha")).alias("kept_sha256"),
    )
