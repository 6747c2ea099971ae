"""Substring, suffix and n-gram duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from refract.llm.common import shared_keys
from refract.llm.components import components
from refract.llm.jaccard_join import floor_depth, lead, near_duplicates, signatures
from refract.llm.substring_dedup import cover_for, dedup_substrings, difference_cover
from refract.llm.suffix_dedup import dedup_bytes, induce

from .conftest import SCHEMA, shingles, words


def covered(units, window, first, doc):
    """Units covered by a window that starts in a smaller document; first: window -> smallest document."""
    out = [False] * len(units)
    for j in range(len(units) - window + 1):
        if first[tuple(units[j : j + window])] < doc:
            out[j : j + window] = [True] * window
    return out


def smallest(rows, units, window):
    first = {}
    for i, u in sorted((i, units(t)) for i, t in rows if i is not None):
        for j in range(len(u) - window + 1):
            first.setdefault(tuple(u[j : j + window]), i)
    return first


def brute_words(rows, window=50):
    first = smallest(rows, words, window)
    out = Counter()
    for i, t in rows:
        w = words(t)
        c = covered(w, window, first, i) if i is not None else [False] * len(w)
        kept = " ".join(x for x, gone in zip(w, c) if not gone)
        out[i, len(w), sum(c), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def brute_bytes(rows, window=50):
    units = lambda t: (t or "").encode()
    first = smallest(rows, units, window)
    out = Counter()
    for i, t in rows:
        b = units(t)
        c = covered(b, window, first, i) if i is not None else [False] * len(b)
        kept = bytes(x for x, gone in zip(b, c) if not gone)
        runs = len(re.findall(b"\1+", bytes(c)))
        out[i, len(b), sum(c), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("v", [1, 2, 3, 7, 13, 31])
def test_difference_cover(v):
    d = difference_cover(v)
    assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_every_window_pair_shares_an_anchor():
    v, cover, length = cover_for(50)
    assert v - 1 + length <= 50
    for i in range(v):
        for j in range(v):
            assert any((i + s) % v in cover and (j + s) % v in cover for s in range(v))


def test_substrings_equal_brute_force(corpus):
    rows, df = corpus
    got = dedup_substrings(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words([r[:2] for r in rows])
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_bytes_equal_brute_force(corpus):
    rows, df = corpus
    got = dedup_bytes(df).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes([r[:2] for r in rows])
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("heavy", [0, 3])
def test_bytes_of_heavy_grams_equal_brute_force(corpus, heavy):
    """Grams with more contexts than a task should hold are judged window by window, with the same result."""
    rows, df = corpus
    got = dedup_bytes(df, with_text=False, heavy_rows=heavy).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes([r[:2] for r in rows])


def test_one_string_in_many_contexts(spark):
    """A 24-byte string in 3,000 different contexts, of which a task may hold 100."""
    r = random.Random(14)
    rows = [(i, f"{r.random()} the very same short phrase {r.random()} " + ("and a longer passage that only some of the texts have in common" if i % 5 == 0 else "")) for i in range(3000)]
    got = dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False, heavy_rows=100).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(rows)


def test_repeated_ids_and_null_ids(spark):
    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(None, long), (1, long), (1, long), (1, other), (2, other), (2, "short"), (None, None)]
    df = spark.createDataFrame([(i, t, None, None, 0, None, 0, None) for i, t in rows], SCHEMA)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(df).collect()) == brute_words(rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_bytes(df).collect()) == brute_bytes(rows)


def test_empty_tables(empty):
    assert dedup_substrings(empty).count() == dedup_bytes(empty).count() == near_duplicates(empty).count() == 0


def test_induction_equals_brute_force():
    r = np.random.default_rng(3)
    window, reach, n = 12, 5, 300
    context = r.integers(97, 99, (n, reach + window)).astype(np.uint8)
    group = r.integers(0, 4, n)
    near = r.integers(0, 3, n)
    far = near + r.integers(0, 3, n)
    owner = r.integers(0, 50, n)
    mask = induce(group, context, near, far, owner, window)
    for i in range(n):
        for level in range(reach + 1):
            want = near[i] <= level <= far[i] and any(
                group[j] == group[i] and near[j] <= level <= far[j] and owner[j] < owner[i] and (context[j, reach - level : reach - level + window] == context[i, reach - level : reach - level + window]).all()
                for j in range(n)
            )
            assert bool(mask[i] >> level & 1) == want


def test_shared_keys_of_a_hot_key(spark):
    def emit(batch):
        ids = batch.column("doc_id").to_numpy()
        yield np.concatenate((np.full(len(ids), 5), ids + 100)).astype(np.uint64), np.concatenate((ids, ids))

    got = shared_keys(spark.range(500).withColumnRenamed("id", "doc_id"), emit).collect()
    assert sorted((r.doc_id, r.key) for r in got) == [(i, 5) for i in range(500)]


def brute_links(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = defaultdict(int)
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 5 * common >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i), links[i]) for i, s in sets.items()}


def test_jaccard_equals_brute_force(corpus):
    rows, df = corpus
    got = {(r.doc_id, r.n_shingles, r.class_id, r.n_links) for r in near_duplicates(df).collect()}
    assert got == brute_links([r[:2] for r in rows])


def test_a_large_group_of_near_copies(spark):
    r = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(450):
        w = list(base)
        w[r.randrange(120)] = f"x{r.randrange(40)}"
        w[r.randrange(120)] = f"y{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = {(r.doc_id, r.n_shingles, r.class_id, r.n_links) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_links(rows)


def repeated_rows():
    """Ids that several texts share: near copies, clean texts, exactly repeated rows, and rows without an id or words."""
    r = random.Random(3)
    text = lambda mark: " ".join(f"{mark}{r.randrange(900)}" for _ in range(60))
    near = lambda t: t + " edited"
    a, b, c, d, e = (text(x) for x in "abcde")
    return [(1, a), (1, b), (2, near(a)), (3, near(b)), (4, c), (4, c), (5, d), (2, e), (6, near(e)), (6, near(a) + " twice"), (None, a), (7, ""), (7, None), (5, near(d)), (8, near(c)), (8, near(c)), (9, " ".join(c.split()))]


def test_jaccard_of_repeated_ids_equals_brute_force(spark):
    rows = repeated_rows()
    by_row = {i: t for i, (k, t) in enumerate(rows) if k is not None}
    want = Counter({(None, len(shingles(t)), None, 0): 1 for k, t in rows if k is None})
    brute = {i: (n, root, links) for i, n, root, links in brute_links(by_row.items())}
    for i, (n, root, links) in brute.items():
        group = [rows[j][0] for j in brute if brute[j][1] == root]
        want[rows[i][0], n, min(group), links] += 1
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.class_id, r.n_links) for r in got) == want


def test_near_copies_keep_one_row_of_each_group(spark):
    from corpus_pipeline import near_copies

    rows = repeated_rows()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in near_copies(spark, docs, "").collect())
    brute = {i: root for i, _, root, _ in brute_links([(i, t) for i, (k, t) in enumerate(rows) if k is not None and words(t)])}
    assert sum(got.values()) == len(set(brute.values())) + 3
    for root in set(brute.values()):
        group = [rows[i] for i in brute if brute[i] == root]
        kept = [x for x in set(group) if got[x]]
        assert len(kept) == 1 and got[kept[0]] == 1 and kept[0][0] == min(i for i, _ in group)
    assert got[None, rows[0][1]] == got[7, ""] == got[7, None] == 1


def test_floor_depth_meets_its_recall():
    d = floor_depth(0.8)
    assert 1 - (1 - 0.8**d) ** 24 >= 0.99999 > 1 - (1 - 0.8 ** (d + 1)) ** 24


def test_leaders_join_whatever_is_linked():
    """Chains of sets, each at 0.8 to the next: any two linked sets below a node end in one group, unlike sets don't."""
    r = np.random.default_rng(5)
    sets, chain = [], []
    for c in range(6):
        pool = list(r.integers(1, 1 << 62, 300, dtype=np.uint64))
        for k in range(12):
            sets.append(np.sort(np.array(pool[12 * k : 12 * k + 120], np.uint64)))
            chain.append(c)
    first = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    minima = signatures(np.concatenate(sets), first).reshape(len(sets), -1).astype(np.uint16)
    keys = np.array([x.tobytes() for x in minima[:, :8].astype(">u2")])
    a, b = lead(keys, np.arange(len(sets)), minima)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a, b):
        assert chain[x] == chain[y]
        root[find(x)] = find(y)
    for c in range(6):
        assert len({find(i) for i in range(len(sets)) if chain[i] == c}) == 1


def test_a_shared_phrase_makes_no_cell(spark):
    """Texts that are half boilerplate share nodes, but links are only between the near copies among them."""
    r = random.Random(11)
    phrase = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([*phrase, *(f"t{r.randrange(10**6)}" for _ in range(60))])) for i in range(150)]
    rows += [(500 + i, rows[i][1] + " more") for i in range(0, 150, 3)]
    got = {(x.doc_id, x.n_shingles, x.class_id, x.n_links) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_links(rows)


def test_cells_of_many_blocks(spark, monkeypatch):
    """A group over several blocks: links within and between blocks are all counted."""
    from refract.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    r = random.Random(12)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randrange(3)):
            w[r.randrange(90)] = f"x{r.randrange(30)}"
        rows.append((i, " ".join(w)))
    got = {(x.doc_id, x.n_shingles, x.class_id, x.n_links) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_links(rows)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(150, 99)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 99 for i in range(99, 160))
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
