"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from refract.llm import spelling as S
from refract.llm import textscan as T

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SCHEMA = "doc_id long, text string, word string, n string, id int, key string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    n = Counter()
    for i, t in rows:
        for w in RUN.findall(t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= 7
    return {w: k for w, k in n.items() if k >= 2}


def brute(rows):
    n = counted(rows)
    form, out = {}, {}
    for w in n:
        close = [v for v in n if v != w and near(v, w)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
        out[w] = len(close)
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, n[w], out[w], form[w], n[form[w]] if form[w] else None, root))
    return Counter(rows)


def found(df):
    return Counter((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, "z") for i, t in rows], SCHEMA).repartition(4)


def corpus(seed=2):
    r = random.Random(seed)
    letters = "abcdeéß×ÿÀ"
    base = ["".join(r.choice(letters) for _ in range(r.randint(6, 12))) for _ in range(40)]

    def vary(w):
        i = r.randrange(len(w))
        return r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]])

    words = []
    for w in base:
        words += [w] * r.choice([2, 15, 150])
        v = vary(w)
        words += [v] * r.choice([1, 2, 12])
        words += [vary(v)] * 2 + [vary(w)] * 2
    r.shuffle(words)
    rows = [(i, r.choice([" ", "-", "1", "漢", "\n"]).join(words[j : j + 50])) for i, j in enumerate(range(0, len(words), 50))]
    return rows + [(5, None), (6, ""), (None, "Abcdefgh Abcdefgh ABCDEFGi"), (7, "aaaaaaaa aaaaaaa aaaaaaab aaaaaaab AAAAAAA aaaaaaaa"), (7, "aaaaaaaa aaaaaaa"), (8, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 4999 + "\t" + "x" * 4999)]


def test_variants_equal_brute_force(spark):
    rows = corpus()
    assert found(S.spelling_variants(frame(spark, rows))) == brute(rows)


def test_chains_of_forms(spark):
    """Each form ten times as frequent as the one before; the root is the last."""
    chain = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    rows = [(1000 + k, w) for j, w in enumerate(chain) for k in range(2 * 12**j)]
    got = found(S.spelling_variants(frame(spark, rows)))
    assert got == brute(rows)
    assert {x[5] for x in got if x[0] in chain and x[1] > 1} == {"abcdefghij"}


def test_anagrams_are_not_near(spark):
    """Thousands of words of the same letters: their keys are one, their rests are not."""
    r = random.Random(4)
    words = {"".join(r.sample("aabbccddeeff", 12)) for _ in range(3000)}
    rows = [(i, f"{w} {w} {w[:-1]}x {w[:-1]}x") for i, w in enumerate(sorted(words))]
    words = counted(rows)
    at, whole = {}, set(words)
    for w in words:
        for i in range(len(w)):
            at.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    near_of = {w: set() for w in words}
    for (_, rest), found_ in at.items():
        for w in found_:
            near_of[w] |= found_ - {w} | ({rest} & whole)
            if rest in whole:
                near_of[rest].add(w)
    got = {r["word"]: r["n_near"] for r in S.spelling_variants(frame(spark, rows)).collect()}
    assert len(words) > 5000 and got == {w: len(v) for w, v in near_of.items()}


def test_empty_table(spark):
    assert S.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert S.spelling_variants(frame(spark, [(1, None), (2, "short words only")])).count() == 0


@pytest.mark.parametrize("size", [0, 3, 64, 65, 300])
def test_checksums(size):
    data = np.frombuffer(b"q" + bytes(range(97, 123)) * 20, np.uint8)
    start, end = np.array([1, 5]), np.array([1 + size, 5 + size])
    heads = np.array([zlib.crc32(b"12:"), zlib.crc32(b":")], np.uint32)
    got = S.checksums(data, start, end, heads)
    assert got.tolist() == [zlib.crc32(b"12:" + data[1 : 1 + size].tobytes()), zlib.crc32(b":" + data[5 : 5 + size].tobytes())]


def test_runs_equal_the_pattern():
    texts = ["Aé-b", "ÿÀ×", "漢a字bb", "", "z", "é", "ĀaÀ", "a¿b"]
    for s in T.slices(pa.array(texts)):
        w = S.runs(s)
        got = [[s.data[a:b].tobytes().decode() for a, b in zip(w.start[lo:hi], w.end[lo:hi])] for lo, hi in zip(w.first, w.first[1:])]
        assert got == [RUN.findall(t) for t in texts]
