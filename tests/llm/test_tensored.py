"""Near-duplicates by tensored banding against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np

from refract.llm import tensored_banding as B

from .conftest import SCHEMA, shingles

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = [shingles((t or "").translate(LOWER), 3) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    of = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            of[x].append(i)
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        for j, n in Counter(j for x in s for j in of[x] if j > i).items():
            if rows[j][0] is not None and 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                root[find(j)] = find(i)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append((d is None, d))
    out = Counter()
    for i, (d, _) in enumerate(rows):
        c = d if d is None else min(least[find(i)])[1]
        out[d, len(sets[i]), c, d is None or d == c] += 1
    return out


def found(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_equals_brute_force(corpus):
    rows, df = corpus
    assert found(B.near_dedup(df)) == brute([r[:2] for r in rows])


def test_groups_of_near_copies(spark):
    """One large group of edits of one text, chains of edits, letters in both cases, short and null texts."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(120)]
    rows, step = [], list(base)
    for i in range(150):
        w = list(base)
        w[r.randrange(120)] = f"e{i}"
        rows.append((i, " ".join(w).upper() if i % 3 else " ".join(w)))
    for i in range(200, 240):
        step[r.randrange(120)] = f"s{i}"
        rows.append((i, " ".join(step)))
    rows += [(300, "One two"), (301, "one TWO"), (302, "one two three"), (303, "É x y"), (304, "é x y"), (305, ""), (306, None), (306, "one two three"), (None, "one two three"), (2, "a b"), (2, "A B")]
    df = spark.createDataFrame([(i, t, None, None, 0, None, 0, None) for i, t in rows], SCHEMA).repartition(6)
    assert found(B.near_dedup(df)) == brute(rows)


def test_recall_at_the_threshold():
    """The tables find a pair of the threshold's similarity as often as the bound says; a similarity of 1/2 seldom more."""
    assert B.recall(0.85) > 0.99998
    r = np.random.default_rng(1)
    h = r.integers(1, 2**63, (400, 200)).astype(np.uint64)
    met = 0
    for row in h:
        both = B.signatures(np.concatenate((row[:185], row[15:])), np.array([0, 185, 370]))
        same = (both[0] == both[1]).all(axis=1)
        met += bool(same[: B.COLLECTION].any() and same[B.COLLECTION :].any())
    assert both.shape == (2, 2 * B.COLLECTION, B.HALF) and met == 400


def test_groups_whose_rows_come_in_any_order(spark):
    """Pairs and small groups whose members are read from several partitions, as of a large table: no link is lost."""
    r = random.Random(13)
    rows = []
    for g in range(60):
        base = [f"g{g}w{r.randrange(900)}" for _ in range(80)]
        for k in range(2 + g % 4):
            rows.append((len(rows), " ".join([*base[k:], f"own{k}"])))
    coalesce, n = "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"
    before = spark.conf.get(coalesce), spark.conf.get(n)
    spark.conf.set(coalesce, "false")
    spark.conf.set(n, "8")
    try:
        got = found(B.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)))
    finally:
        spark.conf.set(coalesce, before[0])
        spark.conf.set(n, before[1])
    assert got == brute(rows)


def test_nothing_is_broadcast(spark, corpus):
    """Spark takes exploded and compressed tables for small ones, here all of them: no step may broadcast its input."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(60_000)
    before = store.executionsCount()
    B.near_dedup(corpus[1]).count()
    bus.waitUntilEmpty(60_000)
    ran = store.executionsList(before, store.executionsCount() - before)
    plans = [ran.apply(i).physicalPlanDescription() for i in range(ran.size())]
    assert sum("SortMergeJoin" in p for p in plans) > 5
    assert not [p for p in plans if "Broadcast" in p]


def test_empty_table(empty):
    assert B.near_dedup(empty).count() == 0
