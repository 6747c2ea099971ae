"""Spelling variants by anagram hashing.

A word's anagram key is the sum of its letters' code points to the fifth power, whatever their order.  Two words
that differ by one inserted, deleted or replaced letter have keys that differ by that letter's power, or by the
exchange value of two; both cases are found by equal integers when each word gives its own key and, for every
letter that it has, the key without that letter: a key with one removal meets the whole key of the shorter word,
and the removals of both words of an exchange meet each other.

Keys that no other word gives are dropped.  For the others the order of the letters is verified: each word gives,
at the positions of the letter taken out, a 128-bit hash of what is left in its order.  Equal rests under one key
are exactly the near words.  At one position of one rest at most one word for each letter of the alphabet meets,
and for those counts and the two most frequent words are enough, so neither anagrams nor variants are ever paired
with each other; anagrams of one multiset, however many, are spread by their rests.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan as T
from .common import materialise, partitions
from .conversation_trie import CRC32

LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: One of so many occurrences (by document and word) is read without one letter.
EDIT_ONE_IN = 31
POWER = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Words of more bytes are checksummed one by one.
_LONG = 64


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> np.uint32(1)) ^ np.uint32(0xEDB88320), x >> np.uint32(1))
    return x


_CRC = _crc_table()


def runs(s: T.Slice) -> T.Words:
    """Maximal runs of [A-Za-z\\u00C0-\\u00FF]: in UTF-8 the latter are 0xC3 and one more byte."""
    n = len(s.data)
    if not n:
        return T.words(s)
    letter = _LETTER[s.data]
    wide = np.flatnonzero(s.data == 0xC3)
    letter[wide] = True
    letter[wide[wide + 1 < n] + 1] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, letter[:-1]
    before[s.offsets[s.offsets < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, letter[1:]
    ends = s.offsets[1:]
    after[ends[ends > 0] - 1] = False
    start, end = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    return T.Words(start, end, np.searchsorted(start, s.offsets))


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """crc32 of each head's bytes followed by data[start:end]; heads: crc32 of the bytes before."""
    size = end - start
    out = ~heads.astype(np.uint32)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= _LONG]
    sizes = -size[order]
    for k in range(_LONG if len(order) else 0):
        at = order[: np.searchsorted(sizes, -k, "left")]
        if not len(at):
            break
        out[at] = _CRC[(out[at] ^ data[start[at] + k]) & np.uint32(255)] ^ (out[at] >> np.uint32(8))
    out = ~out
    for i in np.flatnonzero(size > _LONG):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(heads[i]))
    return out


def count_words(s: T.Slice, ids: list) -> tuple[list[str], np.ndarray]:
    """Words of at least LEAST_LETTERS letters in a slice of documents, after edits, and how often each occurs."""
    w = runs(s)
    data = _LOWER[s.data]
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    letters = points[w.end] - points[w.start]
    keep = np.flatnonzero(letters >= LEAST_LETTERS)
    doc = np.searchsorted(w.first, keep, "right") - 1
    start, end, letters = w.start[keep], w.end[keep], letters[keep]
    heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    h = checksums(data, start, end, heads[doc])
    edited = h % EDIT_ONE_IN == 0
    whole = T.word_hashes(T.Slice(s.row, data, s.offsets), T.Words(start, end, w.first))
    plain = np.flatnonzero(~edited)
    _, at, n = np.unique(whole[plain], return_index=True, return_counts=True)
    at = plain[at]
    found = [data[a:b].tobytes().decode() for a, b in zip(start[at], end[at])]
    counts = n.tolist()
    for i in np.flatnonzero(edited & (letters > LEAST_LETTERS)):
        word = data[start[i] : end[i]].tobytes().decode()
        cut = int(h[i]) % len(word)
        found.append(word[:cut] + word[cut + 1 :])
        counts.append(1)
    return found, np.array(counts, np.int64)


def vocabulary(docs: DataFrame) -> DataFrame:
    """id, word, n of the words that occur LEAST_COUNT times at least; ids are in code-point order of the words."""
    base = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for s in T.slices(batch.column("text"), 8 << 20):
                found, n = count_words(s, ids[s.row : s.row + len(s.offsets) - 1])
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(n)], ["word", "n"])

    words = base.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    spread = words.repartitionByRange(partitions(docs.sparkSession), "word").sortWithinPartitions("word")
    return materialise(spread.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")


def powers(points: np.ndarray) -> np.ndarray:
    """The part of each letter in an anagram key."""
    return points.astype(np.int64) ** POWER


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points (all under 256) of the words of a column, and first index of each word (n + 1)."""
    texts = column.to_pylist()
    first = np.concatenate(([0], np.cumsum([len(x) for x in texts], dtype=np.int64)))
    return np.frombuffer("".join(texts).encode("latin-1"), np.uint8), first


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, id, letter: the key of each word (letter 0) and the keys without each of its letters."""
    for batch in batches:
        if not batch.num_rows:
            continue
        points, first = _letters(batch.column("word"))
        ids = batch.column("id").to_numpy()
        total = np.add.reduceat(powers(points), first[:-1])
        own = np.unique(np.repeat(np.arange(len(ids)), np.diff(first)) << 8 | points)
        of, letter = own >> 8, (own & 255).astype(np.int16)
        key = np.concatenate((total, total[of] - powers(letter)))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate((ids, ids[of]))), pa.array(np.concatenate((np.zeros(len(ids), np.int16), letter)))], ["key", "id", "letter"])


_BASES = (T.WORD_BASE, T.WORD_BASE_2)
_VALUE = [T.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(m)) for m in (0xA24BAED4963EE407, 0x9FB21C651E98DF25)]


def rests(points: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """128-bit hashes: of every word, and of every word without the letter at each position, in their order."""
    whole, rest = [], []
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for base, value in zip(_BASES, _VALUE):
        up, down = T.powers(base, len(points) + 1)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(value[points] * up[:-1], out=total[1:])
        lo, hi, at = total[first[:-1]], total[first[1:]], np.arange(len(points))
        whole.append(T.mix((hi - lo) * down[first[:-1]]))
        # What stands behind the gap moves one place to the front.
        rest.append(T.mix((total[:-1] - lo[of]) * down[first[of]] + (hi[of] - total[at + 1]) * down[first[of] + 1]))
    return whole, rest


def _rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, one, two (hash of the rest), at (position; -1: whole word), fresh (first of equal rests), id, n."""
    for batch in batches:
        if not batch.num_rows:
            continue
        points, first = _letters(batch.column("word"))
        ids, n = batch.column("id").to_numpy(), batch.column("n").to_numpy()
        wanted = np.zeros((len(ids), 256), bool)
        lists = batch.column("letters")
        wanted[np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = True
        whole, rest = rests(points, first)
        total = np.add.reduceat(powers(points), first[:-1])
        of = np.repeat(np.arange(len(ids)), np.diff(first))
        fresh = np.ones(len(points), bool)
        fresh[1:] = points[1:] != points[:-1]
        fresh[first[:-1]] = True
        alone, some = np.flatnonzero(wanted[:, 0]), np.flatnonzero(wanted[of, points])
        for lo in range(0, max(len(some), 1), 1 << 17):
            a, b = alone if not lo else alone[:0], some[lo : lo + (1 << 17)]
            w = np.concatenate((a, of[b]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((total[a], total[of[b]] - powers(points[b])))),
                    *(pa.array(np.concatenate((whole[k][a], rest[k][b])).view(np.int64)) for k in (0, 1)),
                    pa.array(np.concatenate((np.full(len(a), -1), b - first[of[b]]))),
                    pa.array(np.concatenate((np.ones(len(a), bool), fresh[b]))),
                    pa.array(ids[w]),
                    pa.array(n[w]),
                ],
                ["key", "one", "two", "at", "fresh", "id", "n"],
            )


def near(words: DataFrame) -> DataFrame:
    """id, n_near, best (n, id of the most frequent near word, the smallest of ties) of the words (id, word, n)."""
    keys = materialise(words.mapInArrow(_keys, "key long, id long, letter short"), "keys")
    cut = F.sum(F.when(F.col("letter") > 0, 1).otherwise(0))
    shared = keys.groupBy("key").agg(cut.alias("cut"), F.count(F.lit(1)).alias("all")).where("cut > 1 OR (cut > 0 AND all > cut)").select("key")
    letters = keys.join(shared, "key").groupBy("id").agg(F.collect_set("letter").alias("letters"))
    found = materialise(words.join(letters, "id").mapInArrow(_rests, "key long, one long, two long, at long, fresh boolean, id long, n long"), "rests")
    place = ["key", "one", "two"]
    cuts, alone = found.where("at >= 0"), found.where("at < 0")
    # Replaced: what shares a rest and a position.  A window holds one word for each letter at most.
    others = Window.partitionBy(*place, "at")
    ranked = others.orderBy(F.desc("n"), "id")
    top = F.struct("n", F.negative("id").alias("minus"))
    replaced = cuts.select(
        "id", (F.count(F.lit(1)).over(others) - 1).alias("near"), F.row_number().over(ranked).alias("rank"),
        F.max(top).over(others).alias("best"), F.lead(top).over(ranked).alias("next"),
    ).where("near > 0").select("id", "near", F.when(F.col("rank") == 1, F.col("next")).otherwise(F.col("best")).alias("best"))
    # Inserted or deleted: a rest that is a word.
    short = alone.select(*place, F.col("id").alias("short"), F.col("n").alias("short_n"))
    pairs = cuts.where("fresh").join(short, place).select("id", "n", "short", "short_n")
    one = F.lit(1).cast("long").alias("near")
    up = pairs.select(F.col("short").alias("id"), one, top.alias("best"))
    down = pairs.select("id", one, F.struct(F.col("short_n").alias("n"), F.negative("short").alias("minus")).alias("best"))
    every = replaced.unionByName(up).unionByName(down)
    return every.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best")).select("id", "n_near", F.col("best.n").alias("best_n"), F.negative("best.minus").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """id, root: the end of the chain of links (id, form) that starts at each id.

    Every link leads to a word at least RATIO times as frequent, so there are few rounds.
    """
    at = links.select("id", F.col("form").alias("root"))
    step = links.select(F.col("id").alias("from"), F.col("form").alias("to"))
    while True:
        at = materialise(at.join(step, F.col("root") == F.col("from"), "left").select("id", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            return at.select("id", "root")
        at = at.drop("moved")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Words of the documents with their near words and the form that they are variants of.

    Words: maximal runs of [A-Za-z\\u00C0-\\u00FF] with A-Z lower-cased; where EDIT_ONE_IN divides h, the crc32 of
    ``<doc_id>:<run>``, the run is read without its code point h % length.  Of these, those of LEAST_LETTERS code
    points that occur LEAST_COUNT times.  Columns: word, n, n_near (words that differ by one code point inserted,
    deleted or replaced), form (the most frequent of them, the smallest of ties, if RATIO times as frequent), form_n,
    root (the last of the chain of forms, or the word).

    * null text has no words; a null doc_id is written as nothing before the colon;
    * repeated rows and ids count each; runs of any length are read whole; other columns are not read;
    * an empty table gives no rows.
    """
    words = vocabulary(docs)
    formed = F.col("best_n") >= RATIO * F.col("n")
    known = words.join(near(words), "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")
    )
    known = materialise(known, "near")
    ends = roots(known.where("form IS NOT NULL").select("id", "form"))
    name = lambda k: words.select(F.col("id").alias(f"{k}_id"), F.col("word").alias(f"{k}_word"))
    linked = known.where("form IS NOT NULL").join(ends, "id").join(name("form"), F.col("form") == F.col("form_id")).join(name("root"), F.col("root") == F.col("root_id"))
    linked = linked.select("word", "n", "n_near", F.col("form_word").alias("form"), "form_n", F.col("root_word").alias("root"))
    rest = known.where("form IS NULL").select("word", "n", "n_near", F.lit(None).cast("string").alias("form"), "form_n", F.col("word").alias("root"))
    return linked.unionByName(rest)


_HEX = "instr('0123456789ABCDEF', substr(b, {}, 1)) - 1"
_BYTES = f"list_transform(range(0, length(b) // 2), lambda i: CAST(16 * ({_HEX.format('2 * i + 1')}) + {_HEX.format('2 * i + 2')} AS BIGINT))"
#: DuckDB form over the table documents.
ORACLE = rf"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
g AS (SELECT w, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS b FROM (SELECT doc_id, w, count(*) AS n FROM r WHERE length(w) >= {LEAST_LETTERS} GROUP BY doc_id, w) x),
h AS (SELECT w, n, {CRC32.format(_BYTES)} AS h FROM g),
e AS (SELECT CASE WHEN h % {EDIT_ONE_IN} = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS w, n FROM h),
v AS (SELECT w AS word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(w) >= {LEAST_LETTERS} GROUP BY w HAVING sum(n) >= {LEAST_COUNT}),
c AS (SELECT word, n, i, substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v) x),
p AS (
  SELECT a.word, b.word AS other, b.n FROM c a JOIN c b ON a.rest = b.rest AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM c a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM c a JOIN v b ON a.rest = b.word),
q AS (SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS k FROM p),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN q.n >= {RATIO} * v.n THEN other END AS form, CASE WHEN q.n >= {RATIO} * v.n THEN q.n END AS form_n FROM v LEFT JOIN q ON q.word = v.word AND k = 1),
s AS (SELECT word, form, word AS tip, 0 AS k FROM f UNION ALL SELECT s.word, f.form, f.word, k + 1 FROM s JOIN f ON f.word = s.form),
z AS (SELECT word, arg_max(tip, k) AS root FROM s GROUP BY word)
SELECT word, n, n_near, form, form_n, root FROM f JOIN z USING (word)
"""
