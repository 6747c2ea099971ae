"""HTML main-text extraction with wrappers: union-free regular expressions inferred for each host.

A page becomes a nested stream of tokens: block elements, furniture (an element that its tag, role or class
marks as such, as one token) and texts.  A wrapper starts as one page and is aligned with one stream after
another.  Where they differ,

* texts that differ at the same place become a text slot, texts that agree stay fixed;
* neighbours, or groups of neighbours, of the same tags become one repeated group;
* tokens that only one of both has, found by looking ahead for the mismatching token in the other, become
  optional.

Two wrappers align like two streams, so the pages of a host are merged as a tree: within a task, then by host
and salt, then by host.  A page is read by matching its stream to the wrapper: fixed strings that different
pages of the host share are template and go, as do slots that consist of links; slots of prose are main text.
Where a page marks its article, or else its main element, plain text in it is main text, as its page says so;
what is in it under a class or id that may mean furniture is main text unless the wrapper tells template or links.
Articles that the host's wrapper repeats, or that main has more prose around, are a list: main is read instead.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions

# HTML element names by their role, and words that mark page furniture in class and id.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp".split())
FURNITURE = frozenset("head nav header footer aside form button select menu dialog script style noscript template textarea iframe fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr popup modal sidebar navbar navigation breadcrumb breadcrumbs pagination pager newsletter subscribe comment comments disqus share sharing social related recommended".split()
)
#: These words mean furniture only outside of an article, or where the wrapper agrees.
DOUBTFUL_WORDS = frozenset(
    "banner notice notices alert overlay side rail widget menu nav toolbar header masthead footer copyright legal discussion replies reply respond signup login search toc skip".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
CLOSED_BY_BLOCK = frozenset({"p"})

#: Elements nested deeper than this keep their texts and give up their own tokens.
MOST_DEEP = 60
#: Neighbours that a repeated group has at most.
LONGEST_GROUP = 4
#: A fixed string is template if so many different pages and half of the pages around it share it.
LEAST_PAGES = 3
#: From so many pages on, a fixed string that fewer than one in SELDOM of them has becomes a slot.
SETTLED, SELDOM = 8, 4
#: Share of a host's prose that a container of a page without article and main must have to be its main text.
REGION = 0.8

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][\w:-]*)([^>]*)>", re.S)
#: A whole attribute: values are consumed with their names, so nothing is found inside of them.
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_WORD = re.compile(r"[a-z]+")


SURE, DOUBTFUL = 2, 1


def _describe(tag: str, attributes: str) -> tuple[int, str]:
    """Whether an element is furniture (SURE, DOUBTFUL or 0), and its label: the tag and the first class without digits.

    Words of class and id mark blocks only: an inline element is part of the text around it.
    """
    furniture, label = SURE if tag in FURNITURE else 0, tag
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in FURNITURE_ROLES or name == "aria-hidden" and value == "true" or name == "hidden" and value not in ("until-found", "false"):
            furniture = SURE
        if name in ("class", "id") and tag in BLOCK and tag not in ("html", "body", "article", "main", "h1"):
            told = set(_WORD.findall(value))
            furniture = max(furniture, SURE if told & FURNITURE_WORDS else DOUBTFUL if told & DOUBTFUL_WORDS else 0)
        if name == "class" and label == tag:
            first = next((w for w in value.split() if w.isalpha()), None)
            label = f"{tag}.{first}" if first else tag
    return furniture, label


class Item:
    """A token of a page or wrapper: an element, a group or a text, with what was seen of it.

    sig: digest of a subtree whose texts are all fixed and that has no repeats or optional parts, else 0.
    seen: the LEAST_PAGES smallest digests of the pages that have this fixed text.  text: of a page's text.
    """

    __slots__ = ("label", "repeat", "optional", "sig", "pages", "chars", "links", "seen", "items", "text", "place")

    def __init__(self, label, sig=0, pages=1, chars=0, links=0, seen=(), items=(), text="", repeat=False, optional=False):
        self.label, self.sig, self.pages, self.chars, self.links = label, sig, pages, chars, links
        self.seen, self.items, self.text, self.repeat, self.optional = seen, items, text, repeat, optional
        self.place = None

    def dump(self) -> list:
        return [self.label, int(self.repeat) + 2 * int(self.optional), self.sig, self.pages, self.chars, self.links, list(self.seen), [x.dump() for x in self.items]]

    @staticmethod
    def load(x: list) -> Item:
        return Item(x[0], x[2], x[3], x[4], x[5], tuple(x[6]), [Item.load(y) for y in x[7]], repeat=bool(x[1] & 1), optional=bool(x[1] & 2))

    def pattern(self) -> str:
        """The regular expression: #text slots, quoted digests of fixed texts, ? * + quantifiers."""
        if self.label == "#":
            out = f"'{self.sig:x}'" if self.sig else "#"
        else:
            inside = " ".join(x.pattern() for x in self.items)
            out = f"({inside})" if self.label[0] == "(" else f"<{self.label}>{inside}</>" if inside else f"<{self.label}/>"
        return out + {(0, 0): "", (1, 0): "+", (0, 1): "?", (1, 1): "*"}[int(self.repeat), int(self.optional)]


def _digest(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "replace")) >> 1 or 1


def parse(page: str) -> Item:
    """The token tree of a page; inline elements are part of the text around them."""
    root = Item("page", items=[])
    # An open element: tag, furniture, whether it has a token; and the open elements that have one.
    stack: list[tuple[str, bool, bool]] = []
    holders = [root]
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    linked = at = hidden = 0

    def flush():
        nonlocal linked
        text = "" if hidden else " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            holders[-1].items.append(Item("#", _digest("#", text), 1, len(text), min(linked, len(text)), text=text))
        linked = 0

    def close(depth: int):
        nonlocal hidden
        for tag, furniture, told in stack[depth:]:
            hidden -= furniture
            open_tags[tag] -= 1
            if told:
                holders.pop()
        del stack[depth:]

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if text and not hidden:
            parts.append(text)
            if open_tags["a"]:
                linked += len(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA[") and not hidden:
                parts.append(html.escape(m[0][9:-3]))
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        edge = tag in BLOCK
        if closing:
            if open_tags[tag]:
                depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                if edge or any(t in BLOCK or f for t, f, _ in stack[depth:]):
                    flush()
                close(depth)
            elif edge:
                flush()
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else size
            continue
        furniture, label = _describe(tag, attributes)
        if edge or furniture == SURE:
            flush()
        if edge and tag not in VOID and stack:
            # A block closes an open paragraph, and the inline elements that were left open in it.
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCK), None)
            if depth is not None and stack[depth][0] in CLOSED_BY_BLOCK:
                close(depth)
        if tag not in VOID and not attributes.endswith("/"):
            told = (edge or furniture == SURE) and not hidden and len(holders) <= MOST_DEEP
            if told:
                item = Item(("", "?", "!")[furniture] + (label if furniture != SURE else tag), items=[])
                holders[-1].items.append(item)
                holders.append(item)
            stack.append((tag, furniture == SURE, told))
            hidden += furniture == SURE
            open_tags[tag] += 1
    flush()
    _sign(root)
    _mark(root, root.sig)
    return root


def _sign(x: Item) -> None:
    if x.label != "#":
        for y in x.items:
            _sign(y)
        x.sig = _digest(x.label, *(y.sig for y in x.items))


def _mark(x: Item, page: int) -> None:
    if x.label == "#":
        x.seen = (page,)
    for y in x.items:
        _mark(y, page)


def anchors(a: list[Item], b: list[Item]) -> list[tuple[int, int]]:
    """Places of the same fixed subtrees, once in each of both, in rising order (the longest such chain)."""
    place: dict[int, int] = {}
    for side in (a, b):
        once: dict[int, int] = {}
        for i, x in enumerate(side):
            if x.sig:
                once[x.sig] = -1 if x.sig in once else i
        if side is a:
            place = once
    pairs = [(place[s], j) for s, j in once.items() if j >= 0 and place.get(s, -1) >= 0 and (b[j].items or b[j].label == "#")]
    pairs.sort(key=lambda p: p[1])
    tails: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (i, _) in enumerate(pairs):
        at = bisect_left(tails, i)
        tails[at:] = [i]
        last[at:] = [k]
        back[k] = last[at - 1] if at else -1
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def runs(items: list[Item], known: frozenset[str]) -> list[tuple[str, list[list[Item]]]]:
    """Items as (label, occurrences): neighbours, or groups of neighbours, of the same labels are one entry.

    known: labels of groups that the other side has; these are groups here even when they occur once.
    """
    out: list[tuple[str, list[list[Item]]]] = []
    names, i, n = [x.label for x in items], 0, len(items)
    while i < n:
        best = 1, 1
        for size in range(1, min(LONGEST_GROUP, n - i) + 1):
            group, count = names[i : i + size], 1
            if size > 1 and len(set(group)) == 1:
                continue
            while names[i + count * size : i + (count + 1) * size] == group:
                count += 1
            if count > 1 or size > 1 and f"({' '.join(group)})" in known:
                best = size, count
                break
        size, count = best
        label = names[i] if size == 1 else f"({' '.join(names[i : i + size])})"
        found = [items[i + k * size : i + (k + 1) * size] for k in range(count)]
        if out and out[-1][0] == label:
            out[-1][1].extend(found)
        else:
            out.append((label, found))
        i += size * count
    return out


def both_runs(a: list[Item], b: list[Item], known: frozenset[str]) -> list[list[tuple[str, list[list[Item]]]]]:
    """Runs of both sides, where what is a group on one side is a group on both."""
    found = [runs(a, known), runs(b, known)]
    more = known.union(x for side in found for x, _ in side if x[0] == "(")
    return found if more == known else [runs(a, more), runs(b, more)]


def pairs(a: list[str], b: list[str]) -> Iterator[tuple[int, int]]:
    """Aligned places (i, j) of two label lists; -1 where one side lacks it.

    A mismatch is resolved by looking ahead for the mismatching label in the other list; the nearer is taken.
    """
    ahead: list[dict[str, list[int]]] = []
    for side in (a, b):
        places: dict[str, list[int]] = {}
        for k, x in enumerate(side):
            places.setdefault(x, []).append(k)
        ahead.append(places)

    def following(side: int, label: str, at: int) -> int:
        places = ahead[side].get(label, ())
        k = bisect_left(places, at)
        return places[k] - at if k < len(places) else 1 << 60

    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            yield i, j
            i, j = i + 1, j + 1
            continue
        skip_a, skip_b = following(0, b[j], i), following(1, a[i], j)
        if skip_a == skip_b == 1 << 60:
            yield i, -1
            yield -1, j
            i, j = i + 1, j + 1
        elif skip_a <= skip_b:
            for _ in range(skip_a):
                yield i, -1
                i += 1
        else:
            for _ in range(skip_b):
                yield -1, j
                j += 1
    for k in range(i, len(a)):
        yield k, -1
    for k in range(j, len(b)):
        yield -1, k


def _one(label: str, occurrence: list[Item], pages: int) -> Item:
    """An occurrence of a run as one item: itself, or a group of its items."""
    if len(occurrence) == 1 and occurrence[0].label == label:
        return occurrence[0]
    return Item(label, 0, min(x.pages for x in occurrence), items=occurrence)


def _join(x: Item, y: Item, pages: int, same_page: bool) -> Item:
    """One item for two of the same label; same_page: of one page or wrapper, else of two that are aligned."""
    count = min(pages, x.pages + y.pages) if not same_page else min(pages, max(x.pages, y.pages))
    sig = x.sig if x.sig == y.sig and not (x.optional or y.optional) else 0
    out = Item(x.label, sig, count, x.chars + y.chars, x.links + y.links, repeat=x.repeat or y.repeat or same_page, optional=x.optional or y.optional)
    if x.label == "#":
        out.sig = x.sig if x.sig == y.sig else 0
        out.seen = tuple(sorted({*x.seen, *y.seen})[:LEAST_PAGES]) if out.sig else ()
    else:
        out.items = merge(x.items, y.items, x.pages + y.pages if not same_page else max(x.pages, y.pages))
    return out


def _loose(x: Item) -> Item:
    """x with all its fixed texts as slots."""
    return Item(x.label, 0, x.pages, x.chars, x.links, (), [_loose(y) for y in x.items], repeat=x.repeat, optional=x.optional)


def _fold(label: str, found: list[list[Item]], pages: int) -> Item:
    """A run as one item: its occurrences merged into one, halves first."""
    level = [_one(label, x, pages) for x in found]
    while len(level) > 1:
        level = [_join(*level[k : k + 2], pages, True) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def merge(a: list[Item], b: list[Item], pages: int) -> list[Item]:
    """The union-free expression that both item lists match."""
    out: list[Item] = []
    known = frozenset(x.label for side in (a, b) for x in side if x.label[0] == "(")

    def gap(left: list[Item], right: list[Item]):
        if len(left) == len(right) == 1 and left[0].label == right[0].label:
            out.append(_join(left[0], right[0], pages, False))
            return
        one, two = both_runs(left, right, known)
        for i, j in pairs([x for x, _ in one], [x for x, _ in two]):
            if i >= 0 and j >= 0:
                out.append(_join(_fold(*one[i], pages), _fold(*two[j], pages), pages, False))
            else:
                x = _fold(*(one[i] if i >= 0 else two[j]), pages)
                out.append(Item(x.label, x.sig, x.pages, x.chars, x.links, x.seen, x.items, repeat=x.repeat, optional=True))

    i = j = 0
    for p, q in anchors(a, b):
        gap(a[i:p], b[j:q])
        out.append(_join(a[p], b[q], pages, False))
        i, j = p + 1, q + 1
    gap(a[i:], b[j:])
    if pages >= SETTLED:
        out = [_loose(x) if x.sig and SELDOM * x.pages < pages else x for x in out]
        # Neighbours that are slots now repeat.
        folded: list[Item] = []
        for x in out:
            if folded and folded[-1].label == x.label and not (x.sig or folded[-1].sig):
                folded[-1] = _join(folded[-1], x, pages, True)
            else:
                folded.append(x)
        out = folded
    return out


def combine(x: Item | None, y: Item) -> Item:
    """The wrapper of all pages of both wrappers."""
    if x is None:
        return y
    return Item("page", x.sig if x.sig == y.sig else 0, x.pages + y.pages, items=merge(x.items, y.items, x.pages + y.pages))


def match(wrapper: list[Item], page: list[Item]) -> None:
    """Set ``place`` of the page's items to the wrapper's items that they align with."""
    known = frozenset(x.label for side in (wrapper, page) for x in side if x.label[0] == "(")

    def tie(w: Item, x: Item):
        x.place = w
        if x.items:
            match(w.items, x.items)

    def gap(left: list[Item], right: list[Item]):
        one, two = both_runs(left, right, known)
        for i, j in pairs([x for x, _ in one], [x for x, _ in two]):
            if i < 0 or j < 0:
                continue
            for k, found in enumerate(two[j][1]):
                # Of a run of wrapper items, occurrences take one each and the last takes the rest.
                place = one[i][1][min(k, len(one[i][1]) - 1)]
                if len(found) == 1 and len(place) == 1:
                    tie(place[0], found[0])
                else:
                    inside = place[0].items if len(place) == 1 else place
                    for w, x in zip(inside, found):
                        tie(w, x)

    i = j = 0
    for p, q in anchors(wrapper, page):
        gap(wrapper[i:p], page[j:q])
        tie(wrapper[p], page[q])
        i, j = p + 1, q + 1
    gap(wrapper[i:], page[j:])


def _tag(label: str) -> str:
    return label.partition(".")[0]


def _inside(x: Item, tag: str) -> list[Item]:
    """The outermost elements of a tag."""
    return [z for y in x.items if y.label != "#" for z in ([y] if _tag(y.label) == tag else _inside(y, tag))]


def _texts(x: Item, around: int, doubtful: bool = False) -> Iterator[tuple[Item, int, bool]]:
    """Texts of a page, with the number of pages that have the element around them, and whether one around is doubtful."""
    for y in x.items:
        if y.label == "#":
            yield y, around, doubtful
        else:
            yield from _texts(y, y.place.pages if y.place is not None else 1, doubtful or y.label[0] == "?")


def _template(x: Item, around: int) -> bool:
    w = x.place
    return w is not None and w.sig == x.sig and len(w.seen) >= LEAST_PAGES and 2 * w.pages >= around


def _links(x: Item) -> bool:
    w = x.place if x.place is not None else x
    return 2 * w.links > w.chars


def _marked(page: Item) -> list[Item]:
    """The elements by which a page marks its main text: its article, or else main."""
    articles, mains = _inside(page, "article"), _inside(page, "main")
    chars = lambda found: sum(len(t.text) for x in found for t, n, doubtful in _texts(x, 1) if not (doubtful or _links(t) or _template(t, n)))
    listed = len(articles) > 1 and any(x.place is not None and x.place.repeat for x in articles)
    within = [y for x in mains for y in _inside(x, "article")]
    if mains and articles and (listed or chars(mains) > 2 * chars(within)):
        return mains
    found = articles or mains
    return found if any(t.text for x in found for t, _, _ in _texts(x, 1)) else mains


def _prose(w: Item) -> int:
    """Code points of the slots of prose in a wrapper's item, over all pages of the host."""
    if w.label == "#":
        return 0 if _links(w) or len(w.seen) >= LEAST_PAGES else w.chars
    return 0 if w.label[0] in "!?" else sum(map(_prose, w.items))


def region(wrapper: Item) -> Item:
    """The innermost container, once in every page that has it, with REGION of the prose of all around it."""
    at = wrapper
    while True:
        whole, best = _prose(at), max((y for y in at.items if y.label != "#"), key=_prose, default=None)
        if best is None or best.repeat or all(y.label == "#" for y in best.items) or _prose(best) < REGION * whole:
            return at
        at = best


def _placed(x: Item, w: Item) -> list[Item]:
    return [z for y in x.items if y.label != "#" for z in ([y] if y.place is w else _placed(y, w))]


def main_text(page: Item, wrapper: Item | None) -> str:
    """Texts of the page's article, else of its main element, else of the slots of prose in the wrapper's region."""
    if wrapper is not None:
        match(wrapper.items, page.items)
    around = wrapper.pages if wrapper is not None else 1
    # Doubtful furniture in an article is text unless the wrapper knows better.
    found = [x.text for m in _marked(page) for x, n, doubtful in _texts(m, around) if not doubtful or not (_template(x, n) or _links(x))]
    if found:
        return " ".join(found)
    parts = _placed(page, region(wrapper)) if wrapper is not None else []
    prose = [(x, n) for part in parts or [page] for x, n, doubtful in _texts(part, around) if not doubtful and not _links(x)]
    # Where the host's template is all that a page has, it is the page's text.
    return " ".join([x.text for x, n in prose if not _template(x, n)] or [x.text for x, _ in prose])


def _dumps(x: Item) -> str:
    return json.dumps(x.dump(), separators=(",", ":"))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, n_pages and wrapper (of all its pages, as JSON) of the table (host, html); a task counts equal pages once."""
    spark = pages.sparkSession
    salts = max(1, int(partitions(spark) ** 0.5))

    def within_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, tuple[Item | None, set[int]]] = {}
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
                tree = parse(page.as_py())
                wrapper, known = held.get(host, (None, set()))
                if tree.sig not in known:
                    known.add(tree.sig)
                    held[host] = combine(wrapper, tree), known
            yield pa.RecordBatch.from_arrays([pa.array([*held], pa.string()), pa.array([_dumps(w) for w, _ in held.values()], pa.string())], ["host", "wrapper"])

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        wrapper: Item | None = None
        for text in sorted(set(part.wrapper)):
            wrapper = combine(wrapper, Item.load(json.loads(text)))
        return pd.DataFrame({"host": [part.host.iloc[0]], "wrapper": [_dumps(wrapper)]})

    found = pages.mapInArrow(within_task, "host string, wrapper string").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    for keys in (["host", "salt"], ["host"]):
        found = found.groupBy(*keys).applyInPandas(fold, "host string, wrapper string").withColumn("salt", F.lit(0))
    return found.select("host", F.get_json_object("wrapper", "$[3]").cast("long").alias("n_pages"), "wrapper")


#: Bytes of wrappers up to which they are broadcast; beyond, pages are shuffled to them by host.
BROADCAST_BYTES = 8 << 20


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """The main text of every page.

    Rows: one per input row, with page_id, url, text (empty if none) and n_chars (its code points).

    * null html counts as empty; null or unparsable url: the host '' has a wrapper of its own;
    * truncated pages and elements left open end with the page; repeated rows get the same text and count
      once in the wrapper; elements nested over MOST_DEEP deep give their texts to the last one within;
    * a page with neither article nor main whose host has fewer than LEAST_PAGES pages has no template yet;
    * other columns are not read; an empty table gives an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_of(F.col("url").cast("string")).alias("host"))
    wrappers = materialise(infer_wrappers(rows.select("host", "html")).where(f"n_pages >= {LEAST_PAGES}").select("host", "wrapper"), "wrappers")
    size = wrappers.agg(F.sum(F.octet_length("host") + F.octet_length("wrapper"))).first()[0] or 0
    joined = rows.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers.hint("merge"), "host", "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held = [], {}
            for host, page, wrapper in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("wrapper")):
                if host not in held:
                    held[host] = Item.load(json.loads(wrapper.as_py())) if wrapper.is_valid else None
                texts.append(main_text(parse(page.as_py()), held[host]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "host", "html", "wrapper").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
