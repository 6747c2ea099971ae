from __future__ import annotations

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text, size=5):
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or (frozenset([tuple(w)]) if w else frozenset())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, at int, owner string"


@pytest.fixture(scope="session")
def corpus(spark):
    """Copies, near copies, shared passages, odd white space, nulls, empty, tiny and long texts; clashing extra columns."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdeéß漢") for _ in range(r.randint(1, 7))) for _ in range(400)]
    draw = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage = draw(70)
    texts = []
    for i in range(60):
        w = draw(r.choice([0, 1, 3, 4, 5, 49, 50, 51, 80, 200]))
        if i % 4 == 0:
            w = w[:20] + passage[r.randint(0, 15) :] + w[20:]
        texts.append(r.choice([" ", "  ", "\n", "\t \x0b"]).join(w))
    for i in range(15):
        w = words(texts[r.randrange(60)])
        for _ in range(1 + len(w) // 150):
            if w:
                w[r.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += [texts[4], texts[4], texts[8], "", "   ", None, " ".join(draw(6000)), "same " * 300, "same " * 300]
    ids = [3 * i + 1 for i in range(len(texts))]
    r.shuffle(texts)
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["a", "b", "é", None]), len(t or ""), "x", 1, "y") for i, t in zip(ids, texts)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
