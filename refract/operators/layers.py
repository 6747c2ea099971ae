"""Envelopes of the nine layers: least and greatest samples at several resolutions, for any gains afterwards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.audio import HOP, SEGMENT_FRAMES
from .mixer import STEMS

#: Samples of a cell of level 0, and cells that one of the next level covers.
CELL, STEP = HOP, 4

PYRAMID = "path string, level int, cell bigint, low array<float>, high array<float>"


def _levels() -> int:
    """Levels of which a whole segment is a whole number of cells; from there on segments share cells."""
    n, size = 0, CELL
    while SEGMENT_FRAMES * HOP % size == 0 and size <= SEGMENT_FRAMES * HOP:
        n, size = n + 1, size * STEP
    return n


def pyramid(layers: DataFrame) -> DataFrame:
    """path, level, cell, low, high: extremes of each layer (in the order of STEMS) over CELL * STEP ** level samples.

    Cells inside a segment are told where it lies; those that several segments share are merged by recording, level
    and cell, up to the one that covers the whole recording.  Of several channels the extremes of all count.
    """
    inner, own = _levels(), SEGMENT_FRAMES * HOP

    def run(batches):
        for part in batches:
            for r in part.itertuples():
                x = np.stack([np.asarray(v, np.float32).reshape(-1, r.channels) for v in r.layers])
                low, high = x.min(axis=2), x.max(axis=2)
                rows, size, level = [], CELL, 0
                whole = r.n_segs * own
                while low.shape[1]:
                    # Cells of a level: of the samples, then of the cells below.
                    edge = np.arange(0, low.shape[1], CELL if level == 0 else STEP)
                    low, high = np.minimum.reduceat(low, edge, axis=1), np.maximum.reduceat(high, edge, axis=1)
                    if level < inner:
                        first = r.seg * (own // size)
                        rows += [(r.path, level, first + i, low[:, i], high[:, i]) for i in range(len(edge))]
                    else:
                        rows.append((r.path, level, r.seg * own // size, low[:, 0], high[:, 0]))
                    if size >= whole or r.n_segs == 1 and low.shape[1] == 1:
                        break
                    level, size = level + 1, size * STEP
                yield pd.DataFrame(rows, columns=["path", "level", "cell", "low", "high"])

    rows = layers.mapInPandas(run, PYRAMID)
    shared = rows.where(F.col("level") >= inner)
    of = lambda f, c: F.array(*(f(F.get(c, i)) for i in range(len(STEMS)))).alias(c)
    return rows.where(F.col("level") < inner).unionByName(shared.groupBy("path", "level", "cell").agg(of(F.min, "low"), of(F.max, "high")))


def envelope(cells: DataFrame, gains: Column) -> DataFrame:
    """path, level, cell, low, high of the mix: the layers' extremes times their gains (array in the order of STEMS), summed.

    Silent layers count for nothing; the true extremes of the mix lie inside.
    """
    total = lambda c: F.aggregate(F.zip_with(F.col(c), gains, lambda x, g: F.when(g > 0, x.cast("double") * g).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)
    return cells.select("path", "level", "cell", total("low").alias("low"), total("high").alias("high"))
