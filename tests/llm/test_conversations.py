"""The prefix trie of conversations against a brute-force trie."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from refract.llm import conversation_trie as C

SCHEMA = "conv_id long, turn long, role string, text string, path string, one long, depth string"


def key(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows, graft):
    """Counter of node rows."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((turn is not None, turn or 0, key(role, text)), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        built[c] = own.get(base, [])[:h] + own[c][h:] if graft else own[c]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    below = defaultdict(lambda: [0, 0])
    children = Counter(n[:-1] for n in members if n)
    for n, m in members.items():
        saved = (len(m) - 1) * len(n[-1][1]) if n else 0
        for d in range(len(n) + 1):
            below[n[:d]][0] += saved
            below[n[:d]][1] += n not in children
    out = Counter()
    for n, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(n))))
        up = min(members[n[:-1]]) if n else None
        out[min(m), len(n), up, len(m), children[n], below[n][1], below[n][0], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def found(df):
    return Counter(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


def sample(seed=5):
    """Shared starts, copies, extensions turn by turn, long ones, null, empty and repeated turns, ties, gaps."""
    r = random.Random(seed)
    said = [(x, y) for x in ("user", "assistant", "", None) for y in ("a", "é" * 3, "", None, "long " * 30)]
    rows = []
    for c in [*range(0, 30), *range(99, 130), 205, 207, -3, -100, -101]:
        n = r.choice([1, 2, 3, 5, 7, 9])
        rows += [(c, i, *r.choice(said[:6] if c % 3 else said)) for i in range(n)]
    long = [(i, *r.choice(said)) for i in range(150)]
    for c, n in zip(range(300, 330), [31, 32, 33, 63, 64, 65, 96, 97, 150, 150, 149, 64, 32, 33] + [r.randint(1, 150) for _ in range(16)]):
        rows += [(c, *t) for t in long[:n]]
        if c % 4 == 0:
            rows.append((c, n, "user", f"own {c}"))
    rows += [(400, None, "user", "b"), (400, None, "user", "a"), (400, 1, "user", "z"), (400, 1, "user", "z"), (400, 1, "tool", "y"), (None, 1, "user", "lost")]
    return rows


@pytest.mark.parametrize("graft", [False, True])
def test_trie_equals_brute_force(spark, graft):
    rows = sample()
    assert found(C.prefix_trie(frame(spark, rows), graft)) == brute(rows, graft)


@pytest.mark.parametrize("segment, run", [(1, 2), (3, 2), (4, 1024)])
def test_short_segments_give_the_same_trie(spark, segment, run):
    rows = sample(segment)
    assert found(C.prefix_trie(frame(spark, rows), True, segment, run)) == brute(rows, True)


def test_many_ranges_are_stitched(spark, monkeypatch):
    """More ranges than a few rows each: nearly every node is open on both sides."""
    monkeypatch.setattr(C, "partitions", lambda s: 41)
    rows = sample(9)
    assert found(C.prefix_trie(frame(spark, rows))) == brute(rows, False)


def test_one_conversation_with_most_of_the_turns(spark, monkeypatch):
    """Its turns are placed over many ranges, in the order of turn."""
    monkeypatch.setattr(C, "partitions", lambda s: 16)
    r = random.Random(3)
    rows = [(7, i // 2, "user", str(r.randint(0, 9))) for i in range(1500)] + [(8, i, "user", "x") for i in range(20)] + [(6, 0, "user", "x")]
    df = frame(spark, rows)
    placed = C.placed(df).where("conv_id = 7").orderBy("place").collect()
    want = sorted((t, key(role, text)) for c, t, role, text in rows if c == 7)
    assert [x.place for x in placed] == list(range(1, 1501)) and [x.key.hex() for x in placed] == [k for _, k in want]
    assert found(C.prefix_trie(df)) == brute(rows, False)


def test_copies_of_one_conversation(spark, monkeypatch):
    """Blocks of the ids that end at one node are hashed in numeric order."""
    monkeypatch.setattr(C, "BLOCK", 40)
    rows = [(c, i, "user", f"turn {i}") for c in range(-5, 400) for i in range(3)]
    assert found(C.prefix_trie(frame(spark, rows))) == brute(rows, False)


def test_empty_table_and_nodes_with_their_turns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.prefix_trie(empty).count() == C.prefix_trie(empty, True).count() == 0
    only_null = frame(spark, [(None, 1, "user", "a")])
    assert C.prefix_trie(only_null).count() == 0
    df = frame(spark, [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a")])
    told = C.node_turns(C.prefix_trie(df), df).orderBy("depth").collect()
    assert [(x.conv_id, x.depth, x.role, x.text, x.n_convs) for x in told] == [(1, 0, None, None, 2), (1, 1, "user", "a", 2), (1, 2, "bot", "b", 1)]


def test_turnless_conversations_belong_to_the_root(spark):
    """100 takes h turns of 100, others' families are absent and they have no turns after h: only the root is left."""
    lone = [c for c in range(1001, 1100) if zlib.crc32(str(c).encode()) % 6 >= 2][:5]
    rows = [(c, i, "user", "a") for c in lone for i in range(2)]
    assert found(C.prefix_trie(frame(spark, rows), True)) == brute(rows, True)
