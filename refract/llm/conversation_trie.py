"""Prefix trie of conversations by a global sort and a stack sweep over adjacent common prefixes.

Turns are known by 128-bit digests.  A conversation is cut into segments of SEGMENT turns; a segment's prefix id
(the xor of 128-bit digests of the segments before it, each with its number) names the node that it hangs from, so
segments sorted by number, prefix id and turns are the leaves, in order, of pieces of the trie of bounded depth,
and every conversation is in the piece of each of its segments.  No row grows with a conversation.

The sorted segments lie in ranges.  In a range, the common prefix of adjacent rows drives a stack of intervals:
depths that have the same members so far.  An interval is closed when a row leaves it, handed to the interval
below it and written as its nodes.  Nodes on the paths of a range's first and last row may go on in the ranges
beside it: their pieces, at most two paths a range, are written as open and summed by id afterwards.

What is summed over a node's subtree is derived from sums over its members.  Each node is owned by its smallest
member, whose own nodes are the lower end of its path.  With C, the code points along a path, over members s:
  sum of n * code points below v  =  sum of C(s)          -  n * C(above v)
  sum of code points below v      =  sum of those s owns  -  those that v's owner owns above v
and leaves are counted with their owners.  A first sweep finds the owners, a second one sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions

#: Turns of a segment; segments of a run whose prefixes are added up together.
SEGMENT, RUN = 32, 1024
KEY = 16
#: The longest head that a conversation takes, and how many conversations share the first of theirs.
HEADS, FAMILY = 6, 100
#: Bytes of a block of ids that are hashed in order.
BLOCK = 1 << 16


def _clean(turns: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))


def _key() -> Column:
    return F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")))


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), key, chars of all turns, in the order of turn (null first), ties by key.

    Turns are counted in sorted ranges; where a conversation goes on in the next range, what the ranges before
    have of it is added, so a conversation of any length is spread.  The driver sees one row for each range.
    """
    spark = turns.sparkSession
    order = ["conv_id", F.asc_nulls_first("turn"), "key", "tie"]
    rows = _clean(turns).select("conv_id", "turn", _key().alias("key"), F.char_length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("tie"))
    rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "conv_id", "key", "chars")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            places = []
            for c in batch.column("conv_id").to_pylist():
                n = n + 1 if c == last else 1
                last = c
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "place"])

    rows = materialise(rows.mapInArrow(count, "part int, conv_id long, key binary, chars long, place long"), "turns")
    found = rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "place")).alias("last")).orderBy("part").collect()
    carries, conv, n = [], None, 0
    for x in found:
        if x["first"] == conv:
            carries.append((x["part"], conv, n))
        same = x["last"]["conv_id"] == conv
        conv, n = x["last"]["conv_id"], x["last"]["place"] + (n if same else 0)
    carry = spark.createDataFrame(carries, "part int, of long, more long")
    joined = rows.join(F.broadcast(carry), "part", "left")
    more = F.when(F.col("conv_id") == F.col("of"), F.col("more")).otherwise(0)
    return joined.select("conv_id", (F.col("place") + more).alias("place"), "key", "chars")


def grafted(rows: DataFrame) -> DataFrame:
    """Placed turns of rebuilt conversations, and a row of place 0 (no key) for each conversation.

    Conversation c takes the first h turns of conversation c - c % 100, h = crc32(c) % 6, in the place of its own
    first h.  At most HEADS - 1 turns of a family's first are gathered in a row.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    convs = rows.select("conv_id").distinct().withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    turn = F.struct("place", "key", "chars")
    heads = rows.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < HEADS)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(turn)).alias("head"))
    convs = convs.join(heads, "base", "left").select("conv_id", "h", F.expr("filter(head, x -> x.place <= h)").alias("head"))
    convs = materialise(convs, "heads")
    own = rows.join(convs.select("conv_id", "h", F.when(F.col("head").isNull(), 0).otherwise(F.size("head")).alias("taken")), "conv_id").where("place > h")
    taken = convs.select("conv_id", F.explode("head").alias("x")).select("conv_id", "x.place", "x.key", "x.chars")
    return own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "key", "chars").union(taken).union(starts(convs))


def starts(convs: DataFrame) -> DataFrame:
    return convs.select("conv_id", F.lit(0).cast("long"), F.lit(b""), F.lit(0).cast("long"))


def digest(path: bytes, k: int) -> tuple[int, int]:
    d = hashlib.blake2b(path, digest_size=16, salt=k.to_bytes(8, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def segments(rows: DataFrame, segment: int = SEGMENT, run: int = RUN) -> DataFrame:
    """Segments (conv_id, k, path, chars) with one, two (prefix id), before (code points before it), next ids."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [b"".join(x["key"] for x in turns) for turns in batch.column("turns").to_pylist()]
            chars = [[x["chars"] for x in turns if x["place"]] for turns in batch.column("turns").to_pylist()]
            ids = [digest(p, k) if p else (0, 0) for p, k in zip(paths, batch.column("k").to_pylist())]
            columns = [batch.column("conv_id"), batch.column("k"), pa.array(paths, pa.binary()), pa.array(chars, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x[i] for x in ids], pa.int64()) for i in (0, 1)), pa.array([sum(x) for x in chars], pa.int64())], ["conv_id", "k", "path", "chars", "a", "b", "total"])

    k = F.expr(f"greatest(place - 1, 0) div {segment}").alias("k")
    packed = rows.groupBy("conv_id", k).agg(F.sort_array(F.collect_list(F.struct("place", "key", "chars"))).alias("turns"))
    named = materialise(packed.mapInArrow(name, "conv_id long, k long, path binary, chars array<long>, a long, b long, total long"), "segments")
    named = named.withColumn("run", F.expr(f"k div {run}"))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs, inside = Window.partitionBy("conv_id").orderBy("run"), Window.partitionBy("conv_id", "run").orderBy("k")
    sums = named.groupBy("conv_id", "run").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("total").alias("total"), F.max("k").alias("k"))
    zero = F.lit(0).cast("long")
    over = lambda f, c, w, name: F.coalesce(f(c).over(w), zero).alias(name)
    last = F.max("k").over(Window.partitionBy("conv_id")).alias("last")
    length = F.sum("total").over(Window.partitionBy("conv_id")).alias("whole")
    sums = sums.select("conv_id", "run", over(F.bit_xor, "a", up_to(runs), "one0"), over(F.bit_xor, "b", up_to(runs), "two0"), over(F.sum, "total", up_to(runs), "before0"), last, length)
    within = named.select("conv_id", "run", "k", "path", "chars", "a", "b", over(F.bit_xor, "a", up_to(inside), "one"), over(F.bit_xor, "b", up_to(inside), "two"), over(F.sum, "total", up_to(inside), "before"))
    one, two = F.col("one").bitwiseXOR(F.col("one0")), F.col("two").bitwiseXOR(F.col("two0"))
    return within.join(sums, ["conv_id", "run"]).select(
        "conv_id", "k", "path", "chars", one.alias("one"), two.alias("two"), (F.col("before") + F.col("before0")).alias("before"),
        (F.col("k") == F.col("last")).alias("last"), "whole", one.bitwiseXOR(F.col("a")).alias("end_one"), two.bitwiseXOR(F.col("b")).alias("end_two"),
    )


#: A node: its ids, its parent's, depth, owner and what the owner brings, members, those that end here, sums over
#: members, code points of its last text and before it; open: a piece that others may complete.
NODE = (
    "one long, two long, up_one long, up_two long, depth long, conv_id long, base long, top long, n_turns long, n_convs long, n_ends long,"
    " wholes long, owned long, leaves long, chars long, before long, open boolean"
)
_NAMES = [x.split()[0] for x in NODE.split(",")]


class _Interval:
    """Depths lo + 1 .. hi of a piece that have the same members so far."""

    __slots__ = ("lo", "hi", "row", "owner", "n", "ends", "sums")

    def __init__(self, lo, hi, row, owner, n, ends, sums):
        self.lo, self.hi, self.row, self.owner, self.n, self.ends, self.sums = lo, hi, row, owner, n, ends, sums

    def add(self, owner, n, sums):
        self.owner, self.n = min(self.owner, owner), self.n + n
        self.sums = tuple(x + y for x, y in zip(self.sums, sums))


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share."""
    n, i = min(len(a), len(b)), 0
    while i < n and a[i : i + KEY] == b[i : i + KEY]:
        i += KEY
    return i // KEY


def sweep(batches: Iterator[pa.RecordBatch], segment: int = SEGMENT, flush: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Nodes of the sorted segments of a range; those that may go on beyond it are open."""
    stack: list[_Interval] = []
    out: list[tuple] = []
    piece, path, left = None, b"", -1
    first = True

    def write(x: _Interval, open_to: int) -> None:
        """The nodes of a closed interval; depths up to open_to may have begun in the range before."""
        own, chars, before = x.row
        k, one, two = piece
        at = (one, two)
        if x.lo > 0:
            a, b = digest(own[: KEY * x.lo], k)
            at = (one ^ a, two ^ b)
        done = before + sum(chars[: max(x.lo, 0)])
        for j in range(x.lo + 1, x.hi + 1):
            up, here = at, (one, two)
            if j:
                a, b = digest(own[: KEY * j], k)
                here = (one ^ a, two ^ b)
            c = chars[j - 1] if j else 0
            out.append((*here, *(up if j or k else (None, None)), k * segment + j, *x.owner, x.n, x.ends if j == x.hi else 0, *x.sums, c, done, j <= open_to))
            done += c
            at = here

    def close(to: int) -> None:
        """Close what is deeper than to."""
        while stack and stack[-1].hi > to:
            x = stack.pop()
            if x.lo >= to:
                write(x, left)
                if stack:
                    stack[-1].add(x.owner, x.n, x.sums)
            else:
                write(_Interval(to, x.hi, x.row, x.owner, x.n, x.ends, x.sums), left)
                stack.append(_Interval(x.lo, to, x.row, x.owner, x.n, 0, x.sums))

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if name == "open" else pa.int64()) for name, c in zip(_NAMES, zip(*rows))], _NAMES)

    for batch in batches:
        for r in batch.to_pylist():
            at, own = (r["k"], r["one"], r["two"]), r["path"]
            m = len(own) // KEY
            if at == piece:
                common = _common(path, own)
                close(common)
                left = min(left, common)
            else:
                close(-1 if piece and not piece[0] else 0)
                common = -1 if not r["k"] else 0
                left = m if first else -1
                first = False
            piece, path = at, own
            owner, sums = (r["conv_id"], r["base"], r["top"], r["n_turns"]), (r["whole"], r["owned"], r["leaf"])
            if m > common:
                stack.append(_Interval(common, m, (own, r["chars"], r["before"]), owner, 1, int(r["last"]), sums))
            else:
                stack[-1].add(owner, 1, sums)
                stack[-1].ends += int(r["last"])
            if len(out) >= flush:
                yield batch_of(out)
                out.clear()
    left = segment
    close(-1 if piece and not piece[0] else 0)
    if out:
        yield batch_of(out)


def _swept(rows: DataFrame, segment: int) -> DataFrame:
    """The nodes of segments (with base, top, n_turns, owned, leaf of their conversations), each once."""
    order = ["k", "one", "two", "path", "conv_id"]
    columns = ["conv_id", "k", "one", "two", "path", "chars", "before", "last", "whole", "base", "top", "n_turns", "owned", "leaf"]
    spread = rows.select(*columns).repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    nodes = materialise(spread.mapInArrow(lambda batches: sweep(batches, segment), NODE), "nodes")
    owner = ["conv_id", "base", "top", "n_turns"]
    same = ["up_one", "up_two", "depth", "chars", "before"]
    sums = ["n_convs", "n_ends", "wholes", "owned", "leaves"]
    pieces = nodes.where("open").groupBy("one", "two").agg(F.min(F.struct(*owner)).alias("owner"), *(F.first(c).alias(c) for c in same), *(F.sum(c).alias(c) for c in sums))
    pieces = pieces.select("one", "two", *same, *sums, *(F.col(f"owner.{c}").alias(c) for c in owner))
    return nodes.where("NOT open").drop("open").unionByName(pieces)


def _ends(segs: DataFrame) -> DataFrame:
    """one, two, ends_sha256 of the nodes at which conversations end: ids in order, hashed block by block."""
    n = partitions(segs.sparkSession)
    rows = segs.where("last").select("end_one", "end_two", "conv_id").repartitionByRange(n, "end_one", "end_two", "conv_id").sortWithinPartitions("end_one", "end_two", "conv_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, held, size = None, 0, [], 0
        block = lambda: pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, first, ",".join(held))], ["one", "two", "first", "ids"])
        for batch in batches:
            for one, two, c in zip(*(x.to_pylist() for x in batch.columns)):
                if (one, two) != now or size >= BLOCK:
                    if held:
                        yield block()
                    now, first, held, size = (one, two), c, [], 0
                held.append(str(c))
                size += len(held[-1]) + 1
        if held:
            yield block()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for batch in batches:
            found = []
            for one, two, _, ids in zip(*(x.to_pylist() for x in batch.columns)):
                if (one, two) == now:
                    h.update(b",")
                else:
                    if now:
                        found.append((*now, h.hexdigest()))
                    now, h = (one, two), hashlib.sha256()
                h.update(ids.encode())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], ["one", "two", "ends_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, h.hexdigest())], ["one", "two", "ends_sha256"])

    blocks = rows.mapInArrow(pack, "one long, two long, first long, ids string")
    return blocks.repartition(n, "one", "two").sortWithinPartitions("one", "two", "first").mapInArrow(hashed, "one long, two long, ends_sha256 string")


def trie(rows: DataFrame, segment: int = SEGMENT, run: int = RUN) -> DataFrame:
    """Nodes of the trie of conversations (conv_id, place, key, chars); a row of place 0 for each conversation.

    conv_id and depth name a node: its smallest member and the number of its turns.
    """
    segs = materialise(segments(rows, segment, run), "pieces")
    zero = F.lit(0).cast("long")
    turns = segs.groupBy("conv_id").agg(F.sum(F.size("chars")).cast("long").alias("n_turns"))
    bare = segs.select("*", *(zero.alias(c) for c in ("base", "top", "n_turns", "owned", "leaf")))
    leaf = F.when(F.col("n_ends") == F.col("n_convs"), 1).otherwise(0)
    own = _swept(bare, segment).groupBy("conv_id").agg(F.sum("chars").alias("owned"), F.min("depth").alias("top"), F.max(leaf).cast("long").alias("leaf"))
    convs = turns.join(own, "conv_id", "left").select("conv_id", "n_turns", F.coalesce("owned", zero).alias("owned"), F.coalesce("top", F.col("n_turns") + 1).alias("top"), F.coalesce("leaf", zero).alias("leaf"))
    full = segs.join(convs, "conv_id").withColumn("base", F.col("whole") - F.col("owned"))
    nodes = materialise(_swept(full, segment), "summed")
    # Only the uppermost node of an owner has a parent of another owner.
    tops = nodes.where("depth = top AND depth > 0").select(F.col("up_one").alias("one"), F.col("up_two").alias("two"), "conv_id", "depth")
    forks = tops.groupBy("one", "two").agg(F.count(F.lit(1)).alias("forks"))
    forks = materialise(nodes.select("one", "two", F.col("conv_id").alias("parent")).join(forks, ["one", "two"]), "forks")
    above = tops.join(forks.drop("forks"), ["one", "two"]).select("conv_id", "depth", "parent")
    saved = (F.col("wholes") - F.col("n_convs") * F.col("before")) - (F.col("owned") - (F.col("before") - F.col("base")))
    rest = nodes.join(forks.drop("parent"), ["one", "two"], "left").join(_ends(segs), ["one", "two"], "left")
    found = rest.select(
        "conv_id", "depth", "n_convs", (F.coalesce("forks", zero) + (F.col("n_turns") > F.col("depth")).cast("long")).alias("n_children"),
        F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    found = found.join(above, ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") == 0, None).otherwise(F.coalesce("parent", "conv_id"))
    return found.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(turns: DataFrame, graft: bool = False, segment: int = SEGMENT, run: int = RUN) -> DataFrame:
    """The prefix trie of conversations (conv_id, turn, role, text); graft: of the rebuilt ones (``grafted``).

    A node is a distinct sequence of first turns (role, text); the root has none.  Columns: conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes in its subtree), saved_tokens
    (over its subtree, (n_convs - 1) times the code points of a node's last text), ends_sha256 (SHA-256 of the
    comma-joined ids, in numeric order, of the members that end here).

    * turns go by turn, null first; turns that tie go by the MD5 of role and text; repeated rows are turns each;
    * null role or text is empty; rows with a null conv_id belong to no conversation and are left out;
    * other columns are not read; an empty table has no nodes, not even a root.
    """
    rows = materialise(placed(turns), "placed")
    return trie(grafted(rows) if graft else rows.union(starts(rows.select("conv_id").distinct())), segment, run)


def node_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of ungrafted conversations with role and text of their last turn (null for the root)."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), _key())
    said = _clean(turns).withColumn("depth", F.row_number().over(order).cast("long")).select("conv_id", "depth", "role", "text")
    return nodes.join(said, ["conv_id", "depth"], "left")


#: crc32 of a list of bytes, unsigned.
CRC32 = "xor(list_reduce(list_prepend(4294967295, {}), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
#: DuckDB form over the table conversations, grafted.
ORACLE = f"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, length(coalesce(text, '')) AS chars, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, key, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS place FROM t),
c AS (SELECT conv_id, {CRC32.format("list_transform(range(1, length(n) + 1), lambda i: CAST(ascii(substr(n, i, 1)) AS BIGINT))")} % {HEADS} AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS n FROM t) x),
r AS (
  SELECT c.conv_id, 0 AS own, p.place, key, chars FROM c JOIN p ON p.conv_id = c.conv_id - c.conv_id % {FAMILY} AND p.place <= h
  UNION ALL SELECT c.conv_id, 1, p.place, key, chars FROM c JOIN p ON p.conv_id = c.conv_id AND p.place > h),
l AS (SELECT conv_id, list(key ORDER BY own, place) AS keys, list(chars ORDER BY own, place) AS chars FROM r GROUP BY conv_id),
m AS (SELECT conv_id, keys, chars, len(keys) AS n FROM l UNION ALL SELECT conv_id, [], [], 0 FROM c WHERE conv_id NOT IN (SELECT conv_id FROM l)),
b AS (SELECT conv_id, n, d, md5(array_to_string(keys[1:d], ',')) AS id, CASE WHEN d > 0 THEN md5(array_to_string(keys[1:d - 1], ',')) END AS up, CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS c FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM m) x),
v AS (
  SELECT d, id, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(c) AS c,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM b GROUP BY d, id),
k AS (SELECT d - 1 AS d, up AS id, count(*) AS n_children FROM v WHERE d > 0 GROUP BY d, up),
f AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (d, id)),
a AS (
  SELECT b.d, b.id, sum((f.n_convs - 1) * f.c) AS saved_tokens, count(*) FILTER (f.n_children = 0) AS n_leaves
  FROM f JOIN b ON b.conv_id = f.conv_id AND b.d <= f.d GROUP BY b.d, b.id)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, o.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN a USING (d, id) LEFT JOIN v o ON o.d = f.d - 1 AND o.id = f.up
"""
