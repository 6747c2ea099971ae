"""Language identification with blended-spectrum presence kernels.

The kernel of two texts is the normalised number of byte n-grams (n = 1 .. 3, ASCII letters in lower case)
that both contain.  A Nyström map over landmark texts makes it finite, one-versus-rest ridge regression is
fitted in closed form, and a batch of documents is scored by two matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textscan as T

UNDETERMINED = "und"
ORDERS, DIM_BITS = (1, 2, 3), 13
DIM = 1 << DIM_BITS
#: Bounds of the training sample: rows of a language, rows in all, landmarks.
PER_LANGUAGE, TRAIN_ROWS, LANDMARKS = 800, 4000, 256
#: Parts that the ids of a language are ranked in before they meet.
SALTS = 64
RIDGE = 1e-3
#: Share of a language's learned rows that score under Model.low.
LOW = 0.02
#: Bytes of text that one presence matrix covers.
SCAN_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32


def presence(s: T.Slice) -> np.ndarray:
    """Documents x DIM: whether a hashed n-gram occurs in the document."""
    n_docs = len(s.offsets) - 1
    out = np.zeros((n_docs, DIM), dtype=bool)
    data = _LOWER[s.data]
    doc = np.repeat(np.arange(n_docs, dtype=np.int64), np.diff(s.offsets))
    code = np.zeros(len(data), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint64(256) + data[n - 1 :]
        if n in ORDERS:
            inside = doc[:m] == doc[n - 1 :]
            place = ((code + np.uint64(n << 32)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - DIM_BITS)
            out.reshape(-1)[(doc[:m] * DIM + place.astype(np.int64))[inside]] = True
    return out


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


class Model:
    """Landmark presence bits, weights on landmark kernels, languages; low: by language, the score that LOW of its learned
    rows don't reach, so that single odd rows don't move it."""

    def __init__(self, bits: np.ndarray, weights: np.ndarray, languages: list[str], low: dict[str, float] | None = None):
        self.bits, self.weights, self.languages, self.low = bits, weights, languages, low or {}

    def scores(self, x: np.ndarray) -> np.ndarray:
        marks = unit(np.unpackbits(self.bits, axis=1, count=DIM))
        return unit(x) @ marks.T @ self.weights


def fit(docs: DataFrame) -> Model | None:
    """Learn from the text and lang of documents that aren't held out: at most PER_LANGUAGE rows of a
    language and TRAIN_ROWS in all, those whose ids have the least hashes; of an id that is repeated one row."""
    usable = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    rank = F.xxhash64(F.col("doc_id"), F.lit(5)).alias("rank")
    ids = usable.select("doc_id", "lang", rank).withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(SALTS)))
    # First in each part of a language, so that the ids of one language needn't meet in one task.
    for part in (["lang", "salt"], ["lang"]):
        ids = ids.withColumn("n", F.row_number().over(Window.partitionBy(*part).orderBy("rank", "doc_id"))).where(F.col("n") <= PER_LANGUAGE)
    chosen = [r.doc_id for r in ids.orderBy("n", "rank").limit(TRAIN_ROWS).select("doc_id").collect()]
    if not chosen:
        return None

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in T.slices(batch.column("text"), SCAN_BYTES):
                bits = np.packbits(presence(s), axis=1)
                rows = batch.slice(s.row, len(bits))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("lang"), pa.array([b.tobytes() for b in bits], pa.binary())], ["doc_id", "lang", "bits"])

    # An id that many rows repeat gives one of them.
    found = usable.where(F.col("doc_id").isin(chosen)).select("doc_id", "lang", "text").mapInArrow(features, "doc_id long, lang string, bits binary")
    sample = found.groupBy("doc_id").agg(F.min(F.struct("lang", "bits")).alias("x")).select("doc_id", "x.*").collect()
    place = {d: i for i, d in enumerate(chosen)}
    sample.sort(key=lambda r: place[r.doc_id])
    languages = sorted({r.lang for r in sample})
    bits = np.stack([np.frombuffer(r.bits, np.uint8) for r in sample])
    x = unit(np.unpackbits(bits, axis=1, count=DIM))
    y = np.array([languages.index(r.lang) for r in sample])
    # The sample is in order of rank within languages, so its head has every language in it.
    marks = min(LANDMARKS, len(sample))
    cross = (x @ x[:marks].T).astype(np.float64)
    value, vector = np.linalg.eigh(cross[:marks])
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = cross @ root
    share = np.bincount(y, minlength=len(languages))
    weight = (len(y) / (len(languages) * share))[y]
    goal = (y[:, None] == np.arange(len(languages))).astype(float)
    left = phi.T @ (phi * weight[:, None]) + RIDGE * len(y) * np.eye(phi.shape[1])
    right = phi.T @ (goal * weight[:, None])
    solved = np.linalg.solve(left, right)
    own = (phi @ solved).max(axis=1)
    low = {name: float(np.quantile(own[y == i], LOW)) for i, name in enumerate(languages)}
    return Model(bits[:marks], (root @ solved).astype(np.float32), languages, low)


def identify(docs: DataFrame, keep: tuple[str, ...] = (), model: Model | None = None) -> DataFrame:
    """Predict the language of every document from its text alone.

    Rows: one per input row, with doc_id, held_out, lang_pred, score (0 to 1) and the columns in ``keep``.

    * null text or a text without a letter: ``und``, score 0; so too for every row if nothing can be learned;
    * null doc_id: not held out and not learned from; null lang: not learned from; ties go to the first language;
    * repeated rows are predicted alike; an empty table gives an empty result; other columns are not read.

    model: one that was fitted before; else it is fitted here.
    """
    model = model or fit(docs)
    kept = [c for c in keep if c != "doc_id"]
    kinds = dict(docs.dtypes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").alias("__text"), F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("__letters"), *kept)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column("__letters").to_numpy(zero_copy_only=False)
            names = np.full(len(letters), UNDETERMINED, dtype=object)
            score = np.zeros(len(letters))
            if model is not None:
                for s in T.slices(batch.column("__text"), SCAN_BYTES):
                    f = model.scores(presence(s))
                    rows = slice(s.row, s.row + len(f))
                    names[rows] = np.array(model.languages, dtype=object)[f.argmax(axis=1)]
                    score[rows] = np.clip(f.max(axis=1), 0, 1)
                names[~letters] = UNDETERMINED
                score[~letters] = 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score), *(batch.column(c) for c in kept)], ["doc_id", "held_out", "lang_pred", "score", *kept])

    return rows.mapInArrow(predict, ", ".join(["doc_id long, held_out boolean, lang_pred string, score double", *(f"`{c}` {kinds[c]}" for c in kept)]))
