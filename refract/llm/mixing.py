"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's target in words becomes whole passes over the source and a remainder.  The remainder is an
exact quota: it is split among output shards as drawing that many words without replacement would, by
halving the shards again and again (one hypergeometric draw at each node).  In its shard, each document is
a block of words; blocks are drawn in a permuted order until the quota is met, so blocks are disjoint and
the last is cut.  A second permutation gives the order of the mix inside the shard.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan as T
from .common import materialise

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
#: Documents that a shard has about; more of them make more shards.
SHARD_DOCS = 4096
#: Shards below a branch of the tree, which one task splits; those above are split before.
BRANCH = 4096


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: words of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = [np.diff(T.words(s).first) for s in T.slices(batch.column("text"))]
            size = np.concatenate(size) if size else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(size.astype(np.int64))], ["doc_id", "source", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, size long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target: share of all words by weight, no source above cap times its words.

    Weights repeat over the sources by code point, null last.  What a capped source can't take goes to the
    others by weight: target = least(cap * size, level * weight), where level is the greatest of
    (words - those of the i lowest caps) / (weight of the others) over i.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy()
    below = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(below), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    s = s.withColumn("level", left / rest)
    return s.select("source", "source_size", F.least("most", F.max("level").over(every) * F.col("weight")).alias("target"))


def _log_factorials(a: int, d: int) -> float:
    """log((a + d)! / a!), without the cancellation of two huge logarithms."""
    if d < 0:
        return -_log_factorials(a + d, -d)
    if a < 1000:
        return math.lgamma(a + d + 1) - math.lgamma(a + 1)
    b = a + d
    return (a + 0.5) * math.log1p(d / a) + d * (math.log(b) - 1) + (1 / b - 1 / a) / 12 - (b**-3 - float(a) ** -3) / 360


#: Populations from which numpy's own generator refuses to draw.
NUMPY_POPULATION = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n are good that are drawn without replacement; the exact law at every size.

    Beyond numpy's range by rejection: the law is log-concave, so a uniform middle part and exponential tails,
    both scaled by the chance of the mode, lie above it.
    """
    if not n:
        return 0
    if good + bad < NUMPY_POPULATION:
        return int(rng.hypergeometric(good, bad, n))
    total, low, high = good + bad, max(0, n - bad), min(n, good)
    mode = (n + 1) * (good + 1) // (total + 2)
    mode = min(max(mode, low), high)
    if low == high:
        return low
    # A lower bound of the mode's chance keeps the envelope above the law.
    spread = math.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1)))
    peak = 0.9 / (1 + math.sqrt(2 * math.pi) * spread)
    wide = 1 + peak / 2
    while True:
        u, v, w = (1 - rng.random() for _ in range(3))
        y = v * wide / peak if u <= wide / (1 + wide) else (wide - math.log(v)) / peak
        k = mode + (1 if rng.random() < 0.5 else -1) * round(y)
        if not low <= k <= high:
            continue
        d = k - mode
        # Ratio of the chances of k and of the mode, by the four factorials that k moves.
        moved = (
            _log_factorials(mode, d) + _log_factorials(good - mode, -d) + _log_factorials(n - mode, -d) + _log_factorials(bad - n + mode, d)
        )
        if math.log(w) + min(0.0, wide - peak * y) <= -moved:
            return k


def split(quota: int, ids: list[int], sizes: list[int], lo: int, hi: int, seed: bytes, unit: int = 1) -> list[int]:
    """Quota among the shards ids of lo .. hi - 1 by their sizes, each at most its size; the sum is the quota.

    A node of the tree is a range of shards and has draws of its own, so any part of the tree can be split
    apart from the others.  unit: shards that an id stands for.
    """
    out = [0] * len(ids)
    at = np.asarray(ids)
    total = [0, *itertools.accumulate(int(x) for x in sizes)]
    stack = [(lo, hi, 0, len(out), int(quota))]
    while stack:
        lo, hi, a, b, n = stack.pop()
        if not n:
            continue
        if hi - lo == 1:
            out[a] = n
            continue
        mid = (lo + hi) // 2
        m = a + int(np.searchsorted(at[a:b], mid))
        node = hashlib.sha256(seed + f" {lo * unit} {hi * unit}".encode()).digest()
        rng = np.random.Generator(np.random.PCG64(int.from_bytes(node[:16], "little")))
        left = hypergeometric(rng, total[m] - total[a], total[b] - total[m], n)
        stack += [(lo, mid, a, m, left), (mid, hi, m, b, n - left)]
    return out


def mix_sources(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Words of each document that the mix takes.

    Rows: one per input row, with doc_id, source, size, source_size, target (of the source), taken (words,
    repeats counted; the sum over a source is its target, rounded), shard and position (from 1: the place in the
    shard's shuffled order, of documents that nothing is taken of too).

    * null text: size 0, nothing taken; null source: a source of its own, last; null doc_id: an id like others;
    * a document is taken at most ceil(cap) times; sources of size 0 have the target 0;
    * rows that repeat a doc_id are separate blocks; reruns agree, as draws depend on ids and seed only;
    * other columns are not read; an empty table gives an empty result.
    """
    rows = materialise(sized(docs), "sizes")
    count = rows.count()
    shards = 1
    while shards * SHARD_DOCS < count:
        shards *= 2
    branch = min(shards, BRANCH)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.lit(shards)).cast("int"))
    goal = targets(rows, weights, share, cap)
    cells = rows.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    g = goal.select(F.col("source").alias("of"), "source_size", "target")
    cells = materialise(cells.join(g, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("top", F.floor(F.col("shard") / branch).cast("int")), "cells")

    def upper(part: pd.DataFrame) -> pd.DataFrame:
        """Of a source, the tree above the branches."""
        part = part.sort_values("top").reset_index(drop=True)
        size, quota = int(part.source_size[0]), int(np.floor(part.target[0] + 0.5))
        passes = quota // size if size else 0
        part["passes"] = passes
        part["quota"] = split(quota - passes * size if size else 0, part.top.tolist(), part.words.tolist(), 0, shards // branch, f"{seed} {part.source[0]!r}".encode(), branch)
        return part

    def lower(part: pd.DataFrame) -> pd.DataFrame:
        """Of a source, one branch of the tree."""
        part = part.sort_values("shard").reset_index(drop=True)
        lo = int(part.top[0]) * branch
        part["rest"] = split(int(part.quota[0]), part.shard.tolist(), part.words.tolist(), lo, lo + branch, f"{seed} {part.source[0]!r}".encode())
        return part[["source", "shard", "source_size", "target", "passes", "rest"]]

    tops = cells.groupBy("source", "top").agg(F.sum("words").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    tops = tops.groupBy("source").applyInPandas(upper, "source string, top int, words long, source_size long, target double, passes long, quota long")
    tops = tops.select(F.col("source").alias("of"), F.col("top").alias("of_top"), "passes", "quota")
    branches = cells.join(tops, F.col("source").eqNullSafe(F.col("of")) & (F.col("top") == F.col("of_top"))).drop("of", "of_top")
    quota = branches.groupBy("source", "top").applyInPandas(lower, "source string, shard int, source_size long, target double, passes long, rest long")
    quota = quota.withColumnsRenamed({"source": "of", "shard": "cell"})
    drawn = rows.join(quota, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("cell")))
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    drawn = drawn.withColumn("taken", (F.col("passes") * F.col("size") + part).cast("long"))
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id", "source", "size")
    return drawn.select("doc_id", "source", "size", "source_size", "target", "taken", "shard", F.row_number().over(shuffled).alias("position"))
