"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every shingle of five words is hashed once.  The top bits of the hash choose one of ``bins`` bins and the
least hash of a bin is its value; an empty bin borrows from the first occupied one in a random order of bins
that belongs to its own number (optimal densification).  The low ``BITS`` bits of each value are kept as two hex digits, and
likeness takes out the share of agreements that low bits have by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SHINGLE, BIN_BITS, BITS = 5, 7, 8
BINS = 1 << BIN_BITS
#: Bins that an empty bin probes by number; then the rest of its probing order is taken at once.
PROBES = 16
#: Parts, by the hash of the text, of the rows of a doc_id that many rows repeat (null among them).
PARTS_BITS = 8


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS).cast("int")


def with_values(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the densified low bits of the BINS minima (array of int), null for a text without words."""
    a, b, c, d = (f"__{out}_{x}" for x in "abcd")
    hashed = F.transform(F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    df = df.withColumn(a, hashed)
    at = lambda i, k: F.get(a, i + k)
    many = F.transform(F.sequence(F.lit(0), F.size(a) - SHINGLE), lambda i: F.xxhash64(*(at(i, k) for k in range(SHINGLE))))
    few = F.when(F.size(a) > 0, F.array(F.xxhash64(F.lit(SHINGLE), a))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(b, F.when(F.size(a) >= SHINGLE, many).otherwise(few))
    # Signed order sorts the bins apart as well, so the first of each bin is its least value.
    df = df.withColumn(c, F.sort_array(b))
    first = F.filter(c, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(c, i - 1))))
    df = df.withColumn(c, first)
    df = df.withColumn(d, F.struct(F.transform(c, _bin).alias("bin"), F.transform(c, lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")).alias("low")))
    df = df.withColumn(a, _dense(d))
    # The probing order of bin i: PROBES rehashes of i, then all bins by the hash of i and the bin; both are
    # the same for every text, and one of the latter is always occupied.
    tries = lambda i: [F.get(a, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
    order = lambda i: F.transform(F.arrays_zip(F.col(d)["bin"].alias("bin"), F.col(d)["low"].alias("low")), lambda x: F.struct(F.xxhash64(i, F.lit(PROBES), x["bin"]).alias("rank"), x["low"].alias("low")))
    rest = lambda i: F.array_min(order(i))["low"]
    full = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.coalesce(F.get(a, i), *tries(i), rest(i)))
    return df.withColumn(out, F.when(F.size(F.col(d)["bin"]) > 0, full)).drop(a, b, c, d)


def _dense(d: str) -> Column:
    """BINS values, null in empty bins, from the occupied bins in order."""
    place = lambda i: F.array_position(F.col(d)["bin"], i).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.get(F.col(d)["low"], place(i) - 1))


def packed(values: str) -> Column:
    """The fingerprint string: two hex digits a bin; empty for a text without words."""
    return F.coalesce(F.lower(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), "")), F.lit(""))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two fingerprints, corrected for chance agreement of low bits."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda m: m))
    chance = 2.0**-BITS
    score = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(F.col(a).isNull() & F.col(b).isNull(), 1.0).when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(score)


def with_next(docs: DataFrame, ranges: int) -> tuple[DataFrame, list[str]]:
    """Rows dealt to ranges of doc_id, each range closed by a copy (ghost) of the first row that follows it.

    One shuffle of the texts.  The driver sees the bounds, an id for each range; a row finds its range among
    them in two steps of the square root of their number.  An id that holds more than a range's share of the
    rows repeats among the bounds; its rows are parted further by their hash, which is their order as well.
    """
    bounds = docs.agg(F.percentile_approx("okey", [i / ranges for i in range(1, ranges)], max(10_000, 4 * ranges))).first()[0] if ranges > 1 else []
    bounds = bounds or []
    cuts = sorted(set(bounds))
    heavy = sorted({a for a, b in zip(bounds, bounds[1:]) if a == b})
    step = max(1, int(len(cuts) ** 0.5))
    literal = lambda xs: F.lit(list(xs)) if xs else F.array().cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda c: c < F.col("okey")))
    coarse = below(literal(cuts[step - 1 :: step])) * step
    range_ = F.col("coarse") + below(F.slice(literal(cuts), F.col("coarse") + 1, step))
    part = F.when(F.array_contains(literal(heavy), F.col("okey")), 1 + (1 << PARTS_BITS - 1) + F.shiftright("h", 64 - PARTS_BITS)).otherwise(0)
    number = (F.col("range") * ((1 << PARTS_BITS) + 1) + part).alias("bucket")
    own = docs.withColumn("coarse", coarse).withColumn("range", range_).withColumn("bucket", number).drop("coarse", "range")
    # A row for each range: small however many documents there are.
    firsts = materialise(own.groupBy("bucket").agg(F.min(F.struct("okey", "h")).alias("least")), "ranges")
    last = firsts.agg(F.max("bucket")).first()[0]
    before = F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.lit(last))
    to = firsts.select(before.alias("to"), F.col("least.okey").alias("first_okey"), F.col("least.h").alias("first_h"))
    ghosts = docs.join(F.broadcast(to), (F.col("okey") == F.col("first_okey")) & (F.col("h") == F.col("first_h")))
    ghosts = ghosts.withColumn("bucket", F.col("to").cast("int")).drop("to", "first_okey", "first_h")
    return own.withColumn("bucket", F.col("bucket").cast("int")).withColumn("ghost", F.lit(0)).unionByName(ghosts.withColumn("ghost", F.lit(1))), ["ghost", "okey", "h"]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text, whose second half comes from the next document.

    The edited text replaces the last floor(n_chars / 2) code points by the first as many (or all) of the
    next document by ascending doc_id; after the last comes the first.

    Rows: one per input row, with doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    * null text counts as empty; a text without words has the fingerprint '' (likeness 1 with another such
      text, 0 with any other); a text of one to four words has one shingle, all its words;
    * null doc_ids come last; rows that repeat a doc_id follow each other by the hash of their text;
    * a table of one row is its own next document; an empty table gives an empty result;
    * other columns of ``docs`` are not read.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("okey", F.coalesce("doc_id", F.lit((1 << 63) - 1))).withColumn("h", F.xxhash64("text"))
    dealt, order = with_next(rows, 4 * n)
    w = Window.partitionBy("bucket").orderBy(*order)
    dealt = dealt.repartition(n, "bucket").withColumn("next", F.coalesce(F.lead("text").over(w), F.lit("")))
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next", F.lit(1), half))
    dealt = dealt.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", edited).drop("next")
    dealt = with_values(dealt, "text", "own").drop("text")
    dealt = with_values(dealt.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)), "edited", "other").drop("edited")
    # Ghosts stand for their documents here too, so a null lead can only be a text without words.
    dealt = dealt.withColumn("follower", F.lead("own").over(w)).where("ghost = 0")
    return dealt.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        packed("own").alias("fingerprint"),
        packed("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"),
        likeness("own", "follower").alias("near_next"),
    )
