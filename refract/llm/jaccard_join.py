"""N-gram Jaccard join by a MinHash LSH forest, verified exactly.

Texts with the same set of five-word shingles are one class.  Each class has a place in TREES tries: its key
there is DEPTH minima of 16 bits, so keys in sorted order are the leaves of the trie in order.

* Matches are looked for from the deepest prefix upwards.  A node at which the chance that a pair at the
  threshold shares no such node falls to 1 - RECALL is the floor: nobody goes above it.  The classes below a
  floor node that share its most frequent full key are matched first, with one of them, the hub.
* The prefix of a class that is close to the hub isn't shortened any further.  The others below the node are
  read in the order of the trie, each is compared with the leaders so far and is close to one or a leader.
* Close is by all minima of both, so classes that merely share a frequent phrase don't meet.  If two classes
  are linked, the later of them in any shared node is at most one link further from the leader of the earlier
  than that one, and the wider radius joins them: nothing that shares a node is lost but by sampling error.

Classes so joined form cells.  A cell is verified on its shingles: every set is written as its difference to
that of the cell's hub, and for the differences A and B of two sets, whose sizes aren't in question,
|a & b| = |hub| - |a lost| - |b lost| + |A & B|.  Differences of near copies are short; they meet in blocks,
where links are counted by matrix products, so a group of thousands costs counts and not rows for its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .common import materialise, partitions, sorted_groups, squeezed, unsent, unsqueeze
from .components import components

SHINGLE, THRESHOLD = 5, (4, 5)
TREES, DEPTH, RECALL = 24, 8, 0.99999
#: Estimated similarities from which a class is close to a leader, or joined with it.
CLOSE, JOINED = 0.75, 0.4
#: Classes and compressed text bytes that a block has about.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Shingles that one matrix product covers.
COLUMNS = 4096


def floor_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair of the given similarity shares one with the wanted chance."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _sets(s: T.Slice, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every document in ascending order, and first index of each document (n + 1)."""
    w = T.words(s)
    h, doc = T.shingles(T.word_hashes(s, w), w.first, shingle)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(s.offsets)))


def _per_document(values: np.ndarray, first: np.ndarray, f, empty) -> np.ndarray:
    out = np.full(len(first) - 1, empty, dtype=values.dtype)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = f.reduceat(values, first[some])
    return out


def signatures(h: np.ndarray, first: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> np.ndarray:
    """Documents x trees x depth: 16 bits of each minimum, big-endian, so that keys sort as bytes."""
    out = np.empty((len(first) - 1, trees * depth), ">u2")
    seeds = T.mix(np.arange(1, trees * depth + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)) | np.uint64(1)
    some = np.flatnonzero(np.diff(first))
    low = np.zeros(len(first) - 1, np.uint64)
    for k, seed in enumerate(seeds):
        x = h * seed
        x ^= x >> np.uint64(31)
        if len(some):
            low[some] = np.minimum.reduceat(x, first[some])
        out[:, k] = (T.mix(low) >> np.uint64(48)).astype(np.uint16)
    return out.reshape(-1, trees, depth)


def _minima(column) -> np.ndarray:
    """Rows x minima from a binary column of signatures."""
    return np.frombuffer(b"".join(x.as_py() for x in column), ">u2").astype(np.uint16).reshape(len(column), -1)


def lead(keys: np.ndarray, classes: np.ndarray, minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, leader) edges that join the classes below one node, each with the leaders before it that it joins.

    Classes come in the order of the trie.  The state of a node is one row for each leader, however many classes
    are close to it, and leaders that are joined already aren't told again: a class gives one edge at most, and
    so does a leader.
    """
    order = np.lexsort((classes, keys))
    leaders: list[int] = []
    root: list[int] = []
    marks = np.empty((16, minima.shape[1]), np.uint16)
    found: list[tuple[int, int]] = []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i in order:
        like = (marks[: len(leaders)] == minima[i]).mean(axis=1) if leaders else np.zeros(0)
        near = np.flatnonzero(like >= JOINED)
        apart = sorted({find(k) for k in near})
        if apart:
            found.append((i, leaders[apart[0]]))
            for k in apart[1:]:
                found.append((leaders[k], leaders[apart[0]]))
                root[k] = apart[0]
        if not (like >= CLOSE).any():
            if len(leaders) == len(marks):
                marks = np.concatenate((marks, np.empty_like(marks)))
            marks[len(leaders)] = minima[i]
            root.append(apart[0] if apart else len(leaders))
            leaders.append(i)
    pair = np.array(found, np.int64).reshape(-1, 2)
    return classes[pair[:, 0]], classes[pair[:, 1]]


def links(diffs: list[np.ndarray], size: np.ndarray, lost: np.ndarray, hub: int, left: np.ndarray, right: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Whether sets left[i] and right[j] have a Jaccard similarity of threshold[0] / threshold[1] at least.

    diffs: shingles that a set and the hub's don't share; lost: how many of them are the hub's; hub: its size.
    """
    n = np.array([len(x) for x in diffs], np.int64)
    owner = np.repeat(np.arange(len(diffs)), n)
    column = np.unique(np.concatenate(diffs), return_inverse=True)[1] if n.sum() else np.zeros(0, np.int64)
    common = np.bincount(column)[column] > 1
    column, owner = np.unique(column[common], return_inverse=True)[1], owner[common]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(left), len(right)), np.float32)
    place = [np.full(len(diffs), -1) for _ in range(2)]
    place[0][left], place[1][right] = np.arange(len(left)), np.arange(len(right))
    last = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, last, COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        m = []
        for at, k in zip(place, (len(left), len(right))):
            part = np.zeros((k, min(COLUMNS, last - lo)), np.float32)
            row = at[owner[a:b]]
            part[row[row >= 0], column[a:b][row >= 0] - lo] = 1
            m.append(part)
        both += m[0] @ m[1].T
    same = hub - lost[left][:, None] - lost[right][None, :] + np.rint(both).astype(np.int64)
    union = size[left][:, None] + size[right][None, :] - same
    return (threshold[1] * same >= threshold[0] * union) & (union > 0)


def _roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of each one's linked component."""
    root = np.arange(n)
    i, j = np.nonzero(linked)
    a, b = left[i], right[j]
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def text_key(text: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _cells(firsts: DataFrame) -> DataFrame:
    """node, root: cells of the classes (class, sig) that the forest joins."""
    depth = floor_depth(THRESHOLD[0] / THRESHOLD[1])
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    leaf = F.expr(f"substring(sig, tree * {2 * DEPTH} + 1, {2 * DEPTH})")
    rows = firsts.select("class", "sig", tree).select("class", "tree", leaf.alias("key")).withColumn("node", F.xxhash64("tree", F.substring("key", 1, 2 * depth)))
    # Map-side sums: full keys first, then the nodes above them.
    leaves = rows.groupBy("node", "key").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("least"))
    nodes = leaves.groupBy("node").agg(F.sum("n").alias("n"), F.max(F.struct("n", F.struct("least"))).alias("most")).where("n > 1").select("node", F.col("most.col2.least").alias("hub"))
    return joined(rows.join(unsent(nodes), "node").where("class <> hub").select("node", "key", "class", "hub"), firsts)


def joined(met: DataFrame, firsts: DataFrame) -> DataFrame:
    """node, root: cells of the classes (class, sig) that meet their nodes' hubs in met (node, key, class, hub).

    A class close to the hub is joined with it; the others below a node are led in the order of their keys.
    """
    n = partitions(firsts.sparkSession)
    met = materialise(met, "matches")
    sigs = unsent(firsts.select(F.col("class").alias("of"), "sig"))
    pairs = met.select("class", "hub").distinct()
    pairs = pairs.join(sigs.withColumnRenamed("sig", "a"), F.col("class") == F.col("of")).drop("of").join(sigs.withColumnRenamed("sig", "b"), F.col("hub") == F.col("of")).drop("of")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                like = (_minima(batch.column("a")) == _minima(batch.column("b"))).mean(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("hub"), pa.array(like)], ["class", "hub", "likeness"])

    known = materialise(pairs.mapInArrow(compare, "class long, hub long, likeness double"), "hubs")
    far = met.join(unsent(known.where(f"likeness < {CLOSE}").select("class", "hub")), ["class", "hub"])
    # A node with one class left has no other pair.
    more = far.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    far = far.join(unsent(more), "node").select("node", "key", "class").join(sigs, F.col("class") == F.col("of")).drop("of")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["node"]):
            a, b = lead(np.array(t["key"].to_pylist()), t["class"].to_numpy(), _minima(t["sig"]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["class", "hub"])

    rest = far.repartition(n, "node").sortWithinPartitions("node", "key").mapInArrow(walk, "class long, hub long")
    edges = known.where(f"likeness >= {JOINED}").select("class", "hub").union(rest).distinct()
    return components(edges, "class", "hub")


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    threshold: tuple[int, int] = THRESHOLD,
    minima: Callable[[np.ndarray, np.ndarray], np.ndarray] = signatures,
    cells: Callable[[DataFrame], DataFrame] = _cells,
) -> DataFrame:
    """Connected groups of texts whose shingle sets have a Jaccard similarity of 4/5 (threshold) at least.

    minima gives the signatures of sets, cells (node, root) the classes that their signatures bring together; the
    default of both is the LSH forest.

    Rows: one per input row, with doc_id, n_shingles (distinct), copy_of (smallest doc_id with the same
    shingles), class_id (smallest doc_id of the connected group), n_links (other documents linked to it,
    copies included), n_text_links (different shingle sets linked to it), text_key (hash of the text), first
    (whether doc_id and text_key are the smallest of the connected group).

    * null text and texts without words have no shingles and no links, each is its own class; a text of one
      to four words has one shingle, all its words;
    * rows with a null doc_id are returned without class and links nothing; rows that repeat a doc_id are
      documents of that id each, with the links of their own text: a class counts rows;
    * other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", text_key("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in T.slices(batch.column("text")):
                h, first = _sets(s, shingle)
                keys = minima(h, first)
                m = len(keys)
                one, two = (_per_document(T.mix(h ^ np.uint64(x)), first, np.add, 0).view(np.int64) for x in (0x1F3D5B79, 0x2468ACE1))
                sig = pa.array([k.tobytes() for k in keys], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.row, m), batch.column("text_key").slice(s.row, m), pa.array(np.diff(first).astype(np.int64)), pa.array(one), pa.array(two), sig], ["doc_id", "text_key", "n", "one", "two", "sig"])

    rows = materialise(base.mapInArrow(sketch, "doc_id long, text_key long, n long, one long, two long, sig binary"), "signatures")
    # A class is a shingle set, known by its digest: a doc_id can be the smallest of several.
    rows = rows.withColumn("class", F.xxhash64("one", "two", "n"))
    owner = F.min(F.struct("doc_id", "text_key"))
    sets = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("class").agg(owner.alias("least"), F.count(F.lit(1)).alias("docs"), F.first("sig").alias("sig"))
    sets = materialise(sets.select("class", F.col("least.doc_id").alias("owner"), F.col("least.text_key").alias("owner_key"), "docs", "sig"), "classes")
    cell = materialise(cells(sets.select("class", "sig")), "cells")  # node, root
    sets = sets.drop("sig")

    # The texts of the cells, once; a cell's root, its hub here, goes to all parts of the cell.
    members = cell.withColumnRenamed("node", "class").join(unsent(sets), "class")
    packed = squeezed(base.where("doc_id IS NOT NULL"), "doc_id", "text_key")
    texts = packed.join(unsent(members), (packed.doc_id == members.owner) & (packed.text_key == members.owner_key)).dropDuplicates(["class"]).select("class", "docs", "root", "ztext")
    texts = materialise(texts, "texts")
    sizes = texts.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("ztext")).alias("bytes"))
    sizes = sizes.select("root", F.greatest(F.ceil(F.col("m") / BLOCK), F.least("m", F.ceil(F.col("bytes") / BLOCK_BYTES))).cast("int").alias("blocks"))
    texts = texts.join(unsent(sizes), "root").withColumn("block", F.pmod(F.xxhash64("class", F.lit(9)), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    hubs = texts.where("class = root").drop("block").withColumn("block", every).withColumn("hub", F.lit(1))
    parts = texts.withColumn("hub", F.lit(0)).unionByName(hubs)

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: tuple[int, int] | None = None
        hub = np.zeros(0, np.uint64)
        for batch in batches:
            at, names = 0, [batch.column(c).to_pylist() for c in ("root", "block", "hub")]
            for row, unpacked in unsqueeze(batch.column("ztext")):
                for s in T.slices(unpacked):
                    h, first = _sets(s, shingle)
                    out: list[tuple] = []
                    for i in range(len(first) - 1):
                        at = row + s.row + i
                        own = h[first[i] : first[i + 1]]
                        if names[2][at]:
                            root, hub = (names[0][at], names[1][at]), own
                            continue
                        assert root == (names[0][at], names[1][at]), "the hub comes first in its block"
                        diff = np.setxor1d(own, hub, assume_unique=True)
                        out.append((at, len(own), (len(diff) + len(hub) - len(own)) // 2, len(hub), diff.view(np.int64)))
                    if out:
                        pick, size, lost, hub_size, diffs = zip(*out)
                        offsets = pa.array(np.concatenate(([0], np.cumsum([len(d) for d in diffs]))).astype(np.int32))
                        kept = batch.take(pa.array(pick))
                        yield pa.RecordBatch.from_arrays(
                            [*(kept.column(c) for c in ("class", "docs", "root", "blocks", "block")), *(pa.array(x, pa.int64()) for x in (size, lost, hub_size)), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(diffs)))],
                            ["class", "docs", "root", "blocks", "block", "size", "lost", "hub_size", "diff"],
                        )

    kinds = "class long, docs long, root long, blocks int, block int, size long, lost long, hub_size long, diff array<long>"
    parts = parts.repartition(n, "root", "block").sortWithinPartitions("root", "block", F.desc("hub"))
    diffs = materialise(parts.select("class", "docs", "root", "blocks", "block", "hub", "ztext").mapInArrow(differ, kinds), "differences")
    dealt = diffs.withColumn("other", every).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "blocks")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["root", "lo", "hi"]):
            ids, docs_, block_, size, lost = (t[c].to_numpy() for c in ("class", "docs", "block", "size", "lost"))
            lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
            lists = t["diff"].combine_chunks()
            values, first = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            found = [values[first[i] : first[i + 1]] for i in range(len(ids))]
            left, right = np.flatnonzero(block_ == lo), np.flatnonzero(block_ == hi)
            if not len(left) or not len(right):
                continue
            hit = links(found, size, lost, int(t["hub_size"][0].as_py()), left, right, threshold)
            if lo == hi:
                np.fill_diagonal(hit, False)
            n_links, n_texts = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            n_links[left] += hit @ docs_[right]
            n_texts[left] += hit.sum(axis=1)
            if lo != hi:
                n_links[right] += hit.T @ docs_[left]
                n_texts[right] += hit.sum(axis=0)
            root = _roots(hit, left, right, len(ids))
            some = np.flatnonzero(n_texts)
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (ids, n_links, n_texts, ids[root])], ["class", "n_links", "n_text_links", "hub"])

    verified = materialise(
        dealt.repartition(n, "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(verify, "class long, n_links long, n_text_links long, hub long"), "links"
    )
    groups = components(verified.where("hub <> class").select("class", "hub").distinct(), "class", "hub")
    counts = verified.groupBy("class").agg(F.sum("n_links").alias("n_links"), F.sum("n_text_links").alias("n_text_links"))
    joined = groups.withColumnRenamed("node", "class").join(unsent(sets), "class")
    heads = joined.groupBy("root").agg(F.min(F.struct("owner", "owner_key")).alias("head"))
    heads = joined.join(unsent(heads), "root").select("class", "head")
    classes = sets.join(unsent(counts), "class", "left").join(unsent(heads), "class", "left").withColumn("head", F.coalesce("head", F.struct("owner", "owner_key")))
    found = rows.select("doc_id", "text_key", "n", "class").join(unsent(classes), "class", "left")
    known = F.col("doc_id").isNotNull()
    zero = F.lit(0).cast("long")
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(known, F.coalesce("owner", "doc_id")).alias("copy_of"),
        F.when(known, F.coalesce("head.owner", "doc_id")).alias("class_id"),
        F.when(known, F.coalesce("n_links", zero) + F.coalesce(F.col("docs") - 1, zero)).otherwise(zero).alias("n_links"),
        F.when(known, F.coalesce("n_text_links", zero)).otherwise(zero).alias("n_text_links"),
        "text_key",
        F.coalesce((F.col("doc_id") == F.col("head.owner")) & (F.col("text_key") == F.col("head.owner_key")), F.lit(True)).alias("first"),
    )
