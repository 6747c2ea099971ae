"""Cross-entropy difference scores from matched target and background bigram models.

Both models share one vocabulary, every word of all documents, and one smoothing.  The background model counts
every document, the target model those of a given set of ids.  A document's score is the mean over its words of
target loss minus background loss: the lower, the more it is like the target.

Documents are dealt to bundles.  A bundle asks for the counts of its distinct words and bigrams, and says how
often it has each; the question is dealt to buckets by hash, summed there over all bundles, and the sums go back
in the order they were asked in.  So each distinct word or bigram of a bundle travels once each way, nothing
is held by every task, and what travels grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .common import materialise, partitions, sorted_groups, squeezed, unsqueeze

#: Bytes of text that a bundle has about.
BUNDLE_BYTES = 4 << 20
#: Target ids up to which they are broadcast; beyond, texts are shuffled to them.
BROADCAST_IDS = 1 << 20
#: Weights of bigram, unigram and uniform estimate.
SMOOTHING = (0.6, 0.35, 0.05)
#: Distinct words that a task counts before it packs them.
PACK_WORDS = 1 << 18
#: Stand for the start of a document and, under a given vocabulary, for all words outside of it.
START, OTHER = np.uint64(0x5AA5C33C0FF01EE1), np.uint64(0xC33C5AA51EE10FF0)
#: Kinds of rows of a bundle.
PAIRS, WORDS, DOCS = 0, 1, 2


def top_words(docs: DataFrame, size: int) -> np.ndarray:
    """Hashes of the most frequent words of all documents, sorted; ties go to the smaller hash."""
    n = partitions(docs.sparkSession)
    buckets = 4 * n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def fold():
            words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            return words, np.bincount(at, weights=np.concatenate([c for _, c in held])).astype(np.int64)

        def emit():
            words, counts = fold()
            bucket = ((words >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            words, counts, bucket = words[order], counts[order], bucket[order]
            edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist()
            rows = [(int(bucket[a]), words[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()) for a, b in zip(edge, [*edge[1:], len(words)])]
            names, *rest = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *(pa.array(x, pa.binary()) for x in rest)], ["bucket", "words", "counts"])

        for batch in batches:
            for s in T.slices(batch.column("text")):
                h, c = np.unique(T.word_hashes(s, T.words(s)), return_counts=True)
                if len(h):
                    held.append((h, c))
                    rows += len(h)
                if rows > 2 * PACK_WORDS:
                    held = [fold()]
                    rows = len(held[0][0])
                    if rows > PACK_WORDS:
                        yield emit()
                        held, rows = [], 0
        if held:
            yield emit()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, most = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for t in sorted_groups(batches, ["bucket"]):
            words = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in t["words"]])
            counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in t["counts"]])
            words, at = np.unique(words, return_inverse=True)
            top, most = np.concatenate((top, words)), np.concatenate((most, np.bincount(at, weights=counts).astype(np.int64)))
            best = np.lexsort((top, -most))[:size]
            top, most = top[best], most[best]
        if len(top):
            yield pa.RecordBatch.from_arrays([pa.array(top.view(np.int64)), pa.array(most)], ["word", "n"])

    parts = docs.select("text").mapInArrow(count, "bucket int, words binary, counts binary")
    best = parts.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(total, "word long, n long")
    rows = best.orderBy(F.desc("n"), "word").limit(size).collect()
    return np.sort(np.array([r.word for r in rows], np.int64).view(np.uint64))


def _tokens(t: pa.Table, vocabulary: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the documents of a bundle: words, the word before each (or START), document of each, words of each."""
    held: list[tuple[np.ndarray, ...]] = []
    for row, texts in unsqueeze(t["ztext"].combine_chunks()):
        for s in T.slices(texts):
            w = T.words(s)
            h = T.word_hashes(s, w)
            if vocabulary is not None:
                at = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
                h = np.where(vocabulary[at] == h, h, OTHER) if len(vocabulary) else np.full(len(h), OTHER)
            n = np.diff(w.first)
            before = np.concatenate(([START], h[:-1])) if len(h) else h
            before[w.first[:-1][n > 0]] = START
            held.append((h, before, row + s.row + np.repeat(np.arange(len(n)), n), n))
    return tuple(np.concatenate(x) for x in zip(*held))


def _bigrams(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return T.mix(before * np.uint64(0x9FB21C651E98DF25) + word)


def _pack(tool: zstandard.ZstdCompressor, *columns: np.ndarray) -> bytes:
    """64-bit columns, byte by byte, so that small numbers are small."""
    return tool.compress(b"".join(c.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns))


def _unpack(tool: zstandard.ZstdDecompressor, payload, columns: int) -> np.ndarray:
    data = np.frombuffer(tool.decompress(payload), np.uint8).reshape(columns, 8, -1)
    return np.ascontiguousarray(data.transpose(0, 2, 1)).view(np.uint64)[:, :, 0]


def _probability(two, context, one, total: int, size: int, where):
    """Smoothed chance of a word: two of context bigrams, one of total words, one of size words; numbers or columns."""
    a, b, c = SMOOTHING
    if not total:
        return two * 0 + 1.0 / size
    # Contexts that were never seen leave the bigram's weight to the unigram.
    return where(context > 0, a * two / where(context > 0, context, 1), a * one / total) + b * one / total + c / size


def _questions(vocabulary: np.ndarray | None, buckets: int):
    """From documents by bundle: (kind, bucket, bundle, payload), the keys of a bucket in order and their counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        for t in sorted_groups(batches, ["bundle"]):
            word, before, doc, _ = _tokens(t, vocabulary)
            if not len(word):
                continue
            hit = t["hit"].to_numpy()[doc]
            count = lambda at, n: [np.bincount(at, minlength=n), np.bincount(at, weights=hit, minlength=n)]  # noqa: B023, E731
            pair, at = np.unique(_bigrams(before, word), return_inverse=True)
            all_, both = np.unique(np.concatenate((word, before)), return_inverse=True)
            asked = (PAIRS, pair, count(at, len(pair))), (WORDS, all_, [*count(both[: len(word)], len(all_)), *count(both[len(word) :], len(all_))])
            out: list[tuple] = []
            for kind, keys, counts in asked:
                # High bits choose the bucket, so the order of keys is that of buckets.
                bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist()
                for lo, hi in zip(edge, [*edge[1:], len(keys)]):
                    out.append((kind, int(bucket[lo]), t["bundle"][0].as_py(), _pack(tool, np.diff(keys[lo:hi], prepend=np.uint64(0)), *(c[lo:hi] for c in counts))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["kind", "bucket", "bundle", "payload"])

    return ask


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums over all bundles for each question; a row of bundle -1 has a bucket's distinct words and their sums."""
    tool, out = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    names = ["bundle", "kind", "bucket", "payload", "distinct", "b", "t"]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    for t in sorted_groups(batches, ["kind", "bucket"]):
        kind, bucket = t["kind"][0].as_py(), t["bucket"][0].as_py()
        width = 3 if kind == PAIRS else 5
        asked = [_unpack(tool, x.as_buffer(), width) for x in t["payload"]]
        questions = [np.cumsum(x[0]) for x in asked]
        keys, at = np.unique(np.concatenate(questions), return_inverse=True)
        sums = [np.bincount(at, weights=np.concatenate([x[c] for x in asked]), minlength=len(keys)) for c in range(1, width)]
        rows = [(bundle, kind, bucket, _pack(out, *(c[np.searchsorted(keys, q)] for c in sums)), 0, 0, 0) for bundle, q in zip(t["bundle"].to_pylist(), questions)]
        if kind == WORDS:
            rows.append((-1, kind, bucket, b"", int(np.count_nonzero(sums[0])), int(sums[0].sum()), int(sums[1].sum())))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _scores(vocabulary: np.ndarray | None, totals: tuple[int, int], size: int):
    """From answers and documents by bundle: the scored documents."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for t in sorted_groups(batches, ["bundle"]):
            docs = t.filter(pc.equal(t["kind"], DOCS))
            if not len(docs):
                continue
            word, before, doc, n = _tokens(docs, vocabulary)
            loss = [np.zeros(len(n)), np.zeros(len(n))]
            if len(word):
                # Rows come by kind and bucket, so answers are in the order of the keys.
                told = [np.concatenate([_unpack(tool, x.as_buffer(), c) for x in t.filter(pc.equal(t["kind"], k))["payload"]], axis=1).astype(np.float64) for k, c in ((PAIRS, 2), (WORDS, 4))]
                _, first, at = np.unique(_bigrams(before, word), return_index=True, return_inverse=True)
                words = np.unique(np.concatenate((word, before)))
                assert told[0].shape[1] == len(first) and told[1].shape[1] == len(words), "an answer to each question"
                i, j = np.searchsorted(words, before[first]), np.searchsorted(words, word[first])
                two, one = told[0], told[1][:2]
                context = told[1][2:]
                for k, model in ((0, 1), (1, 0)):  # target, background
                    each = -np.log(_probability(two[model], context[model][i], one[model][j], totals[model], size, np.where))
                    loss[k] = np.bincount(doc, weights=each[at], minlength=len(n))
            empty = n == 0
            mean = [pa.array(x / np.maximum(n, 1), mask=empty) for x in (*loss, loss[0] - loss[1])]
            yield pa.RecordBatch.from_arrays([docs["doc_id"].combine_chunks(), pa.array(n.astype(np.int64)), *mean], ["doc_id", "n_words", "target_loss", "background_loss", "score"])

    return score


def score_documents(docs: DataFrame, target: DataFrame, vocabulary: int | None = None, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Cross-entropy difference of every document.

    Rows: one per input row, with doc_id, n_words, target_loss and background_loss (mean nats a word) and
    score (their difference).

    * vocabulary: where given, only so many most frequent words count by themselves and all others as one;
    * null text or a text without words: n_words 0, losses and score null;
    * null doc_id: scored, never a target; ids of ``target`` that aren't documents count for nothing; an empty
      target gives a uniform target model; rows that repeat a doc_id are counted and scored each;
    * other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    top = None if vocabulary is None else top_words(own, vocabulary)
    wanted = target.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("of")).distinct().withColumn("mark", F.lit(1))
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marked = own.join(F.broadcast(wanted) if few else wanted.hint("merge"), F.col("doc_id") == F.col("of"), "left").withColumn("hit", F.coalesce("mark", F.lit(0)))
    bundles = max(1, -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bundle_bytes))
    marked = marked.withColumn("bundle", F.pmod(F.xxhash64("doc_id", "text"), F.lit(bundles)).cast("int"))
    packed = squeezed(marked, "doc_id", "hit", "bundle")
    dealt = packed.repartition(n, "bundle").sortWithinPartitions("bundle")
    asked = dealt.mapInArrow(_questions(top, n), "kind int, bucket int, bundle int, payload binary")
    told = asked.repartition(n, "kind", "bucket").sortWithinPartitions("kind", "bucket")
    told = materialise(told.mapInArrow(_answer, "bundle int, kind int, bucket int, payload binary, distinct long, b long, t long"), "answers")
    sums = told.where("bundle < 0").agg(*(F.sum(c).alias(c) for c in ("distinct", "b", "t"))).first()
    totals, size = (sums.b or 0, sums.t or 0), max(1, sums.distinct or 0) if top is None else len(top) + 1
    answers = told.where("bundle >= 0").select("bundle", "kind", "bucket", "payload")
    rows = answers.unionByName(packed.withColumn("kind", F.lit(DOCS)), allowMissingColumns=True)
    rows = rows.repartition(n, "bundle").sortWithinPartitions("bundle", "kind", "bucket")
    return rows.mapInArrow(_scores(top, totals, size), "doc_id long, n_words long, target_loss double, background_loss double, score double")
