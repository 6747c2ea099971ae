"""Decontamination, mixing, scoring, fingerprints, language, pages, chats."""

from __future__ import annotations

import hashlib
import html as html_
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from refract.llm import chat_format, decontaminate, fingerprint, lm_score, mixing
from refract.llm.fingerprint import fingerprint_edits
from refract.llm.html_wrapper import combine, extract_main_text, infer_wrappers, main_text, parse
from refract.llm.language_id import UNDETERMINED, identify
from refract.llm.mixing import mix_sources, split, targets

from .conftest import shingles, words


def test_contained_items_equal_brute_force(spark, corpus):
    rows, _ = corpus
    r = random.Random(5)
    items, docs = [], [(i, t) for i, t, *_ in rows]
    for k in range(40):
        w = [f"q{r.randrange(300)}" for _ in range(r.choice([1, 4, 5, 6, 9, 30, 120]))]
        items.append((k, " ".join(w)))
        for share in (1.0, 0.9, 0.7):
            cut = w[: max(1, int(len(w) * share))]
            filler = [f"z{r.randrange(5000)}" for _ in range(r.choice([0, 20, 3000]))]
            docs.append((10_000 + len(docs), " ".join(filler[: len(filler) // 2] + cut + filler[len(filler) // 2 :])))
    items += [(99, None), (None, "a b c d e f")]
    got = {(x.doc_id, x.item_id, x.n_hits, x.n_shingles) for x in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    five = lambda t: shingles(t) if len(words(t)) >= 5 else frozenset()
    sets = [(i, five(t)) for i, t in docs]
    for k, t in items:
        q = five(t)
        for i, s in sets:
            n = len(q & s)
            if k is not None and q and 5 * n >= 4 * len(q):
                want.add((i, k, n, len(q)))
    assert got == want and len(want) > 30


@pytest.mark.parametrize("places", [2, 5, 20, 50])
def test_items_that_are_spread_over_a_document(spark, places):
    """Parts of an item far apart: the item is found whenever the whole document has 4/5 of its shingles."""
    r = random.Random(places)
    rows, items = [], []
    for i in range(12):
        item = [f"t{i}_{r.randrange(10**6)}" for _ in range(30 * places + 10)]
        cut = sorted(r.sample(range(1, len(item)), places - 1))
        parts = [item[a:b] for a, b in zip([0, *cut], [*cut, len(item)])]
        text = [f"f{r.randrange(3000)}" for _ in range(200)]
        for part in parts:
            text += part + [f"f{r.randrange(3000)}" for _ in range(len(item) // 2)]
        rows.append((i, " ".join(text)))
        items.append((i, " ".join(item)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {i for (i, t), (_, x) in zip(rows, items) if 5 * len(shingles(x) & shingles(t)) >= 4 * len(shingles(x))}
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, bench).collect()}
    assert want and got == {(i, i) for i in want}


def test_passes_by_bytes_of_items(spark, corpus, monkeypatch):
    _, df = corpus
    items = df.select(F.col("doc_id").alias("item_id"), "text").where("doc_id % 5 = 0")
    whole = {tuple(x) for x in decontaminate.contaminated(df, items).collect()}
    monkeypatch.setattr(decontaminate, "BYTES_A_PASS", 3000)
    assert whole == {tuple(x) for x in decontaminate.contaminated(df, items).collect()}


def test_no_items_no_rows(spark, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated(empty, some).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), none).count() == 0


def test_mix_meets_targets(spark, corpus):
    rows, df = corpus
    got = mix_sources(df).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r[0], r[3], len(words(r[1]))) for r in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = dict(zip(names, (5, 2, 1, 5)))
    want, open_, left = {}, set(names), 1.5 * sum(size.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > 2 * size[s]]
        for s in full or list(open_):
            want[s] = 2.0 * size[s] if full else left * weight[s] / total
        left -= sum(want[s] for s in full)
        open_ -= set(full or open_)
    assert all(target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 1 for s in names)
    again = {(r.doc_id, r.size, r.taken, r.shard, r.position) for r in mix_sources(df.repartition(2)).collect()}
    assert again == {(r.doc_id, r.size, r.taken, r.shard, r.position) for r in got}
    assert {r.position for r in got} == set(range(1, len(rows) + 1))


def test_mix_of_many_shards_and_branches(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 8)
    monkeypatch.setattr(mixing, "BRANCH", 4)
    r = random.Random(6)
    rows = [(i, "w " * r.choice([0, 1, 7, 60]), "abc"[r.randrange(3)]) for i in range(300)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken = defaultdict(int)
    for x in got:
        taken[x.source] += x.taken
        assert 0 <= x.taken <= 2 * x.size
    assert len(got) == 300 and len({x.shard for x in got}) > 16 and all(abs(taken[x.source] - x.target) <= 1 for x in got)


def test_mix_of_nothing(spark, empty):
    assert mix_sources(empty).count() == 0
    row = mix_sources(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).first()
    assert (row.size, row.target, row.taken) == (0, 0.0, 0)


def test_splitting_tree_is_exact():
    ids, sizes = [0, 1, 2, 5, 6, 7], [10, 0, 500, 3, 10**13, 77]
    for quota in (0, 1, 300, 5 * 10**12, sum(sizes)):
        out = split(quota, ids, sizes, 0, 8, b"x")
        assert sum(out) == quota and all(0 <= a <= b for a, b in zip(out, sizes))
        # The tree can be split in two parts.
        tops = split(quota, [0, 1], [sum(sizes[:3]), sum(sizes[3:])], 0, 2, b"x", 4)
        assert split(tops[0], ids[:3], sizes[:3], 0, 4, b"x") + split(tops[1], ids[3:], sizes[3:], 4, 8, b"x") == out


@pytest.mark.parametrize("good, bad, n", [(600, 400, 300), (5, 2000, 40), (1000, 1000, 1), (3000, 17, 2900)])
def test_rejection_draws_the_exact_law(monkeypatch, good, bad, n):
    monkeypatch.setattr(mixing, "NUMPY_POPULATION", 0)
    rng = np.random.default_rng(1)
    draws = Counter(mixing.hypergeometric(rng, good, bad, n) for _ in range(20_000))
    chi = cells = 0.0
    for k in range(max(0, n - bad), min(good, n) + 1):
        want = 20_000 * math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n)
        if want >= 5:
            chi, cells = chi + (draws[k] - want) ** 2 / want, cells + 1
    assert chi < cells + 5 * math.sqrt(2 * cells) + 10


def test_huge_draws_have_the_right_spread():
    rng = np.random.default_rng(2)
    good, bad, n = 3 * 10**12, 10**13, 4 * 10**11
    total = good + bad
    spread = math.sqrt(n * good / total * bad / total * (total - n) / (total - 1))
    z = np.array([(mixing.hypergeometric(rng, good, bad, n) - n * good / total) / spread for _ in range(4000)])
    assert abs(z.mean()) < 0.08 and abs(z.std() - 1) < 0.06 and abs((np.abs(z) > 1.96).mean() - 0.05) < 0.015


def test_level_of_capped_sources(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000)], "source string, size long")
    t = {r.source: r.target for r in targets(sizes).collect()}
    assert t["a"] == 20 and t["b"] == pytest.approx((1.5 * 2010 - 20) * 2 / 3) and t["c"] == pytest.approx((1.5 * 2010 - 20) / 3)


def test_scores_equal_brute_force(spark, corpus):
    rows, df = corpus
    target = {r[0] for r in rows[::3]}
    labels = spark.createDataFrame([(i,) for i in [*target, 999_999, None]], "doc_id long")
    got = {r.doc_id: r for r in lm_score.score_documents(df, labels, vocabulary=50).collect()}
    count = Counter(w for r in rows for w in words(r[1]))
    vocabulary = lm_score.top_words(df, 50)
    assert len(vocabulary) == 50
    least = sorted(count.values(), reverse=True)[49]
    assert sum(c > least for c in count.values()) <= 50
    import pyarrow as pa

    from refract.llm import textscan as T

    known = sorted(count)
    hashes = np.concatenate([T.word_hashes(s, T.words(s)) for s in T.slices(pa.array([" ".join(known)]))])
    inside = dict(zip(known, np.isin(hashes, vocabulary)))
    assert min(count[w] for w in known if inside[w]) >= least
    tables = []
    for ids in (target, {r[0] for r in rows}):
        two, context, one = Counter(), Counter(), Counter()
        for r in rows:
            if r[0] in ids:
                w = ["<s>"] + [x if inside[x] else "<unk>" for x in words(r[1])]
                two.update(zip(w, w[1:]))
                context.update(w[:-1])
                one.update(w[1:])
        tables.append((two, context, one, sum(one.values())))
    a, b, c = lm_score.SMOOTHING
    for r in rows:
        w = ["<s>"] + [x if inside[x] else "<unk>" for x in words(r[1])]
        row = got[r[0]]
        assert row.n_words == len(w) - 1
        if len(w) == 1:
            assert row.score is None
            continue
        loss = []
        for two, context, one, n in tables:
            p = lambda u, v: a * (two[u, v] / context[u] if context[u] else one[v] / n) + b * one[v] / n + c / 51  # noqa: B023, E731
            loss.append(-sum(math.log(p(u, v)) for u, v in zip(w, w[1:])) / (len(w) - 1))
        assert row.target_loss == pytest.approx(loss[0], rel=1e-4) and row.background_loss == pytest.approx(loss[1], rel=1e-4)
        assert row.score == pytest.approx(loss[0] - loss[1], abs=1e-4)


@pytest.mark.parametrize("bundle", [1, 5000, 1 << 30])
def test_scores_tell_all_words_apart(spark, bundle):
    """More words than any fixed vocabulary would hold, each with its own counts, however documents are bundled."""
    r = random.Random(4)
    rows = [(i, " ".join(f"w{int(r.paretovariate(0.3)) % 6000}" for _ in range(r.choice([0, 1, 30, 200])))) for i in range(120)]
    rows += [(None, rows[5][1]), (5, "another text of 5"), (7, rows[7][1]), (200, None), *((i, f"seldom{i} common seldom{i}") for i in range(300, 3000))]
    target = {i for i, _ in rows if i is not None and i % 3 == 0}
    got = lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in target], "doc_id long"), bundle_bytes=bundle).collect()
    size = len({w for _, t in rows for w in words(t)})
    assert size > 2047
    tables = []
    for inside in (lambda i: i in target, lambda i: True):
        two, context, one = Counter(), Counter(), Counter()
        for i, t in rows:
            if inside(i):
                w = ["<s>", *words(t)]
                two.update(zip(w, w[1:]))
                context.update(w[:-1])
                one.update(w[1:])
        tables.append((two, context, one, sum(one.values())))
    a, b, c = lm_score.SMOOTHING
    want = Counter()
    for i, t in rows:
        w = ["<s>", *words(t)]
        loss = [0.0, 0.0]
        for k, (two, context, one, n) in enumerate(tables):
            for u, v in zip(w, w[1:]):
                loss[k] -= math.log((a * two[u, v] / context[u] if context[u] else a * one[v] / n) + b * one[v] / n + c / size)
        m = len(w) - 1
        want[i, m, *((round(x / m, 6) if m else None) for x in (*loss, loss[0] - loss[1]))] += 1
    assert Counter((x.doc_id, x.n_words, *(None if v is None else round(v, 6) for v in (x.target_loss, x.background_loss, x.score))) for x in got) == want


def test_scores_of_empty_tables(spark, empty):
    none = spark.createDataFrame([], "doc_id long")
    assert lm_score.score_documents(empty, none).count() == 0
    assert lm_score.score_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none).first().target_loss > 0


def test_fingerprints_estimate_similarity(spark, corpus):
    rows, df = corpus
    got = {r.doc_id: r for r in fingerprint_edits(df).collect()}
    docs = sorted((r[0], r[1] or "") for r in rows)
    error = []
    same = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    for n, (i, t) in enumerate(docs):
        after = docs[(n + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint == "") == (not words(t)) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        error.append(r.near_edited - same(shingles(t), shingles(edited)))
    assert np.sqrt(np.mean(np.square(error))) < 0.08
    by_text = defaultdict(set)
    for i, t in docs:
        by_text[t].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprints_equal_brute_force(spark, corpus):
    """Bins, probing order and low bits by plain Python over Spark's own hashes."""
    rows, _ = corpus
    texts = sorted({r[1] for r in rows if r[1] and len(words(r[1])) < 300}) + ["a b c d e f", "one", "a b c d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprint_edits(df).collect()}
    grams = [(i, *g) for i, t in enumerate(texts) if len(w := words(t)) >= 5 for g in zip(*(w[k:] for k in range(5)))]
    whole = [(i, words(t)) for i, t in enumerate(texts) if 0 < len(words(t)) < 5]
    hashes = defaultdict(set)
    g = spark.createDataFrame(grams, "i long, a string, b string, c string, d string, e string")
    for r in g.select("i", F.xxhash64(*(F.xxhash64(x) for x in "abcde")).alias("h")).collect():
        hashes[r.i].add(r.h)
    g = spark.createDataFrame(whole, "i long, w array<string>")
    for r in g.select("i", F.xxhash64(F.lit(5), F.transform("w", lambda x: F.xxhash64(x))).alias("h")).collect():
        hashes[r.i].add(r.h)
    bins = spark.range(fingerprint.BINS).select(F.col("id").cast("int").alias("i"))
    probes = {r[0]: r[1:] for r in bins.select("i", *(F.pmod(F.xxhash64("i", F.lit(t)), F.lit(fingerprint.BINS)) for t in range(fingerprint.PROBES))).collect()}
    rank = {(r.i, r.j): r.h for r in bins.join(bins.withColumnRenamed("i", "j")).select("i", "j", F.xxhash64("i", F.lit(fingerprint.PROBES), "j").alias("h")).collect()}
    for k, h in hashes.items():
        least = {}
        for x in h:
            b = (x % (1 << 64)) >> (64 - fingerprint.BIN_BITS)
            least[b] = min(x, least.get(b, x))
        out = []
        for i in range(fingerprint.BINS):
            donor = next((b for b in (i, *probes[i]) if b in least), None)
            out.append(least[min(least, key=lambda b: rank[i, b]) if donor is None else donor] % 256)  # noqa: B023
        assert got[k] == bytes(out).hex()


def test_fingerprints_over_many_ranges_and_repeated_ids(spark):
    r = random.Random(13)
    text = lambda: " ".join(f"w{r.randrange(300)}" for _ in range(r.randrange(12)))
    rows = [(r.choice([None, 7, 7, i]), text()) for i in range(400)] + [(5, "same text")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    h = {x.text: x.h for x in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, h[x[1]]))
    want = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((x.doc_id, x.n_chars, x.edited_sha256) for x in fingerprint_edits(df).collect()) == want


def test_fingerprints_of_one_row_and_of_null_ids(spark, empty):
    assert fingerprint_edits(empty).count() == 0
    r = fingerprint_edits(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0
    rows = fingerprint_edits(spark.createDataFrame([(None, "zz"), (2, "abcd"), (1, "")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.edited_sha256 for r in rows}[2] == hashlib.sha256(b"abzz").hexdigest()


def test_language_on_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in identify(df, ("lang",)).collect() if r.held_out]
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark, empty):
    assert identify(empty).count() == 0
    rows = [(i, "the cat and the dog number", "en") for i in range(30)] + [(i, "der Hund und die Katze", "de") for i in range(30, 60)] + [(90, None, "en"), (91, "12 34 !!", "en"), (92, "x", None), (None, "und der", "de")]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[90].lang_pred == got[91].lang_pred == UNDETERMINED and got[90].score == 0
    assert got[3].lang_pred == "en" and got[33].lang_pred == "de" and got[None].held_out is False
    untaught = identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert untaught.lang_pred == UNDETERMINED


def page(body, extra=""):
    return f'<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>{body}<aside>Side</aside>{extra}<footer>&copy; x</footer></body></html>'


def test_main_text(spark):
    rows = [
        (1, "http://a.example/1", page("<article><h1>One &amp; two</h1><p>A  <b>bold</b>\n word&nbsp;here<p>Next</article>")),
        (2, "http://a.example/2", page('<article><h1>Other</h1><div class="ad">Buy</div><p>Text<br>line</p><form>Send</form></article>')),
        (3, "http://a.example/3", page('<article><h1>Third</h1><p>Body</p><section class="comments"><p>Reader says</p></section></article>', '<div class="cookie-notice">Cookies</div>')),
        (4, "http://b.example/1", page('<div class="content"><p>No article here &#233;</p></div>')),
        (5, None, None), (6, "", "plain < text & more"), (7, "http://a.example/4", "<article><p>Cut of"),
    ]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "One & two A bold word here Next", 2: "Other Text line", 3: "Third Body", 4: "No article here é", 5: "", 6: "plain < text & more", 7: "Cut of"}


def test_main_text_of_a_host_with_mixed_templates(spark):
    bodies = {
        "<article><p>A post</p></article><div><p>Below the post</p></div>": "A post",
        "<main><p>A main page</p></main><div><p>Below main</p></div>": "A main page",
        '<div><p>A plain page</p></div><ul><li><a href="/x">Just a link</a></li></ul>': "A plain page",
        '<section class="comments"><p>Reader says</p></section><div><p>A plain page too</p></div>': "A plain page too",
    }
    rows = [(100 * k + i, url, page(body)) for k, url in enumerate(["http://m.example/x", None]) for i, body in enumerate([*bodies] * 2)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = [*bodies.values()] * 2
    assert got == {i: want[i % 100] for i, *_ in rows}


def test_pages_equal_their_articles(spark):
    p = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_main_text(p).collect()}
    for r in p.collect():
        inside = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", r.html, re.S).group(1)
        parts = [" ".join(html_.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?p>|</?h1>|<br>", inside)]
        want = " ".join(x for x in parts if x)
        assert got[r.page_id] == (want, len(want))
    assert extract_main_text(p.limit(0)).count() == 0


@pytest.mark.parametrize(
    "body, want",
    [
        ('<div style="overflow:hidden"><p>Body one.</p></div><p>two</p>', "Body one. two"),
        ('<p title="a hidden gem">Body</p><p>two</p>', "Body two"),
        ('<p data-id="comment-1">Body</p><p data-hidden="false">more</p><p>two</p>', "Body more two"),
        ('<p class="legal">Body</p><p class="side">more</p>', "Body more"),
        ('<p>see <a href="/p?id=related">this link</a> now</p>', "see this link now"),
        ("<p>a <label>b</label> <math><mi>x</mi></math> <object>o</object> <svg><text>s</text></svg> c</p>", "a b x o s c"),
        ('<pre>x <span class="comment">// why</span></pre>', "x // why"),
        ('<p hidden>gone</p><p hidden="">gone</p><p aria-hidden=true>gone</p><p hidden="false">stays</p>', "stays"),
        ('<div class="ad">Buy</div><div id="comment-1">me too</div><p>stays</p>', "stays"),
        ("<p data-x='class=\"ad\"'>stays</p>", "stays"),
    ],
)
def test_attributes_are_read_by_name_and_value(body, want):
    assert main_text(parse(f"<body><article>{body}</article></body>"), None) == want


def test_teasers_do_not_silence_main():
    text = "long main text " * 20
    assert main_text(parse(f"<main><div>{text}</div><section><article>teaser</article></section></main>"), None) == f"{text.strip()} teaser"
    assert main_text(parse(f"<main><article>{text}</article><p>small note</p></main>"), None) == text.strip()


def test_wrapper_decides_on_doubtful_parts_of_articles(spark):
    """A legal paragraph that pages share is template, one of their own is text."""
    rows = [(i, f"http://a.example/{i}", f'<article><p>Text {i} of its own</p><p class="legal">All rights kept</p><p class="side">Aside {i} as well</p></article>') for i in range(9)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Text {i} of its own Aside {i} as well" for i in range(9)}


def test_pages_without_their_article_tags(spark):
    """The wrapper alone finds the texts of the given pages; without it furniture stays."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()
    # The tags that say what is what become classes without a meaning.
    names = dict(zip("article nav footer aside header form".split(), "qa qb qc qd qe qf".split()))
    tags = "|".join(names)

    def plain(page):
        page = re.sub(rf"</(?:{tags})>", "</div>", re.sub('class="[^"]*"', 'class="qz"', page))
        return re.sub(rf"<({tags})\b[^>]*>", lambda m: f'<div class="{names[m[1]]}">', page)

    want = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows)).collect()}
    bare = [(r.page_id, r.url, plain(r.html)) for r in rows]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(bare, "page_id long, url string, html string")).collect()}
    kept = lost = extra = loose = 0
    for i, url, page in bare:
        a, b, c = (Counter(t.split()) for t in (want[i], got[i], main_text(parse(page), None)))
        kept, lost, extra, loose = kept + (a & b).total(), lost + (a - b).total(), extra + (b - a).total(), loose + (c - a).total()
    assert kept >= 0.95 * (kept + lost), (kept, lost)
    assert extra < loose, (extra, loose)


def wrapper(*bodies):
    out = None
    for b in bodies:
        out = combine(out, parse(b))
    return re.sub(r"'[0-9a-f]+'", "''", out.pattern()).removeprefix("<page>").removesuffix("</>")


def test_wrapper_algebra():
    assert wrapper("<p>a</p>", "<p>b</p>") == "<p>#</>"  # a text slot
    assert wrapper("<p>a</p>", "<p>a</p>") == "<p>''</>"  # fixed text
    assert wrapper("<p>a</p>", "<p>b</p><p>c</p><p>d</p>") == "<p>#</>+"  # repeated
    assert wrapper("<h1>a</h1><p>b</p>", "<h1>c</h1><ul><li>x</ul><p>d</p>") == "<h1>#</> <ul><li>''</></>? <p>#</>"  # optional
    assert wrapper("<dl><dt>a<dd>b</dl>".replace("<dd>", "</dt><dd>"), "<dl><dt>c</dt><dd>d</dd><dt>e</dt><dd>f</dd></dl>") == "<dl>(<dt>#</> <dd>#</>)+</>"
    assert wrapper("<p>Welcome</p><p>a</p>", "<p>Welcome</p><p>b</p><p>c</p>") == "<p>''</> <p>#</>+"  # a fixed text beside slots of its path
    assert wrapper("<p>Hello</p><div>1</div>", "<div>2</div><p>Hello</p>", "<p>Hello</p>") == "<div>''</>? <p>''</> <div>''</>?"  # anchored by the fixed text


def test_wrappers_of_wrappers_are_wrappers():
    r = random.Random(8)
    body = lambda: "<h1>T" + str(r.random()) + "</h1>" + "".join(r.choice(["<p>{}</p>", "<p>{}</p>", "<ul><li>{}</li></ul>"]).format(r.random()) for _ in range(r.randint(1, 6))) + "<div>Fixed</div>"
    trees = [parse(body()) for _ in range(24)]
    one = two = None
    for x in trees:
        one = combine(one, x)
    for k in range(0, 24, 6):
        part = None
        for x in trees[k : k + 6]:
            part = combine(part, x)
        two = combine(two, part)
    for w in (one, two):
        assert w.pages == 24 and w.items[-1].pages == 24 and w.items[-1].sig == trees[0].items[-1].sig and len(w.items) < 25


def test_alignment_tells_template_from_text_of_the_same_path(spark):
    """Welcome strings, link lists and texts lie in the same elements: a set of paths couldn't tell them apart."""
    r = random.Random(9)
    prose = lambda: " ".join(f"w{r.randrange(500)}" for _ in range(30))
    texts = [[prose() for _ in range(r.randint(1, 4))] for _ in range(12)]
    rows = [(i, "http://plain.example/x", f'<body><div><p>Welcome to our shop</p>{"".join(f"<p>{t}</p>" for t in x)}<p>All prices in euro</p><p><a href="/{i}">Next {i}</a></p></div></body>') for i, x in enumerate(texts)]
    rows += [(100 + i, "http://few.example/x", f"<div><p>Welcome</p><p>{i}</p></div>") for i in range(2)]  # too few pages for a template
    rows += [(200, "http://copies.example/x", "<p>Same text</p>")] * 5 + [(201 + i, "http://copies.example/y", f"<p>Other {i}</p>") for i in range(3)]  # copies are one page
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit("x")).withColumn("wrapper", F.lit(2)).repartition(3)
    got = Counter((x.page_id, x.text) for x in extract_main_text(df).collect())
    want = Counter({(i, " ".join(x)): 1 for i, x in enumerate(texts)})
    want += Counter({(100 + i, f"Welcome {i}"): 1 for i in range(2)}) + Counter({(200, "Same text"): 5}) + Counter({(201 + i, f"Other {i}"): 1 for i in range(3)})
    assert got == want
    assert infer_wrappers(df.selectExpr("'a' AS host", "html")).count() == 1


def test_odd_pages(spark):
    long = "<body>" + "".join(f"<p>line {i % 7}</p>" for i in range(20_000)) + "<div>" * 20_000 + "deep" + "<b>" * 5000 + "end"
    rows = [(1, "http://h/", long), (None, "http://h/", "<p>no id"), (2, None, None), (3, "::", "<"), (4, "http://h/", "<!-- <p>gone"), (5, "http://h/", "<p>a" + "\U0001f600" + "&#x1F600;&bogus;")]
    got = {x.page_id: (x.text, x.n_chars) for x in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got[1][0].split()) == 40_001 and got[1][0].endswith("line 0 deepend")
    assert got[None][0] == "no id" and got[2] == ("", 0) and got[3][0] == "<" and got[4] == ("", 0) and got[5] == ("a\U0001f600\U0001f600&bogus;", 10)


def test_rotation(spark):
    rows = [(1, 0, "system", "be <|kind|>"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "?"), (2, 0, "system", "alone"), (None, 0, "ann", "lost"), (1, 1, "ann", "hi")]
    got = chat_format.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("of", F.lit(1))).collect()
    assert Counter((r.conv_id, r.perspective) for r in got) == {(1, "ann"): 5, (1, "bob"): 5, (1, "unknown"): 5, (None, "ann"): 1}
    for r in got:
        trained = r.segment[r.mask_from : r.mask_to]
        assert trained == (r.content + "<|im_end|>\n" if r.mask else "") and (r.mask == 1) == (r.role == "assistant")
        assert r.segment.count("<|") == 2
    first = next(r for r in got if r.perspective == "bob" and r.turn == 1)
    assert first.segment == "<|im_start|>user name=ann\nhi<|im_end|>\n"
    assert chat_format.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
