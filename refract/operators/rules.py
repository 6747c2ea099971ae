"""Rule catalogs matched against tag values: every pattern is a literal of one projection, then first hits.

A pattern that comes from a column is compiled anew whenever it differs from the last row's; literals are
compiled once in a task, and no pairs of values and rules are made but the hits.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog

#: Patterns are part of the plan; a larger catalog than this is refused.
MAX_RULES = 1000
STRENGTH = {"strong": 3, "medium": 2, "info": 1}


_WORD = "[A-Za-z0-9_]"
_BEFORE, _AFTER = f"(?<!{_WORD})", f"(?!{_WORD})"
_EDGE = f"(?:{_BEFORE}(?={_WORD})|(?<={_WORD}){_AFTER})"


def _alternatives(pattern: str, at: int, step: int) -> list[str] | None:
    """The alternatives of the group that opens (step 1) or closes (step -1) at a place, if it holds no groups or classes."""
    end = pattern.find(")", at) if step > 0 else at
    start = at if step > 0 else pattern.rfind("(", 0, at)
    inner = pattern[start + 1 : end].removeprefix("?:")
    return None if min(start, end) < 0 or any(c in inner for c in "()[]\\?*") else inner.split("|")


def _is_word(text: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z0-9_]|\\[dw]", text))


def _edge(pattern: str, at: int) -> str:
    """What a word boundary at a place says: one look where the pattern's own edge is a word character, else both."""
    rest, done = pattern[at + 2 :], pattern[:at]
    starts = _alternatives(pattern, at + 2, 1) if rest.startswith("(?:") else None
    optional = re.match(r"(?:\\.|.)[?*]|(?:\\.|.)\{0", rest)
    if (_is_word(rest[:2] if rest[:1] == "\\" else rest[:1]) and not optional) or starts and all(_is_word(x[:1]) for x in starts):
        return _BEFORE
    ends = _alternatives(pattern, at - 1, -1) if done.endswith(")") else None
    last = re.search(r"(\\.|.)(?:\{[1-9]\d*(?:,\d*)?\}|\+)?$", done)
    if ends and all(_is_word(x[-1:]) for x in ends) or last and _is_word(last[1]) and not done.endswith(("?", "*")):
        return _AFTER
    return _EDGE


def portable(pattern: str) -> str:
    """A pattern whose word boundaries are ASCII ones in Java's engine too."""
    parts, at = [], 0
    for m in re.finditer(r"\\\\|\\b", pattern):
        if m[0] == "\\b":
            parts += [pattern[at : m.start()], _edge(pattern, m.start())]
            at = m.end()
    return "(?i)" + "".join(parts) + pattern[at:]


#: Shorter literals than this are found too often to spare a search.
LEAST_NEEDLE = 4
_TOKEN = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", re.S)
_QUANTIFIER = re.compile(r"(?:[?*+]|\{\d+(?:,\d*)?\})[?+]?")


def _closed(pattern: str, at: int) -> int:
    """Where the group that opens at a place is closed."""
    depth = 0
    for m in _TOKEN.finditer(pattern, at):
        depth += (m[0] == "(") - (m[0] == ")")
        if depth == 0:
            return m.start()
    raise ValueError(pattern)


def needles(pattern: str) -> list[str]:
    """Lower-case ASCII literals, one for each alternative, of which the lower-cased text of every match has one.

    Empty where an alternative has none of LEAST_NEEDLE characters: such a pattern must be tried everywhere.
    """
    pattern = re.sub(r"^\(\?[a-z]+\)", "", pattern)
    out, at, runs, groups = [], 0, [""], []
    while at <= len(pattern):
        if at == len(pattern) or pattern[at] == "|":
            best = max(runs, key=len).lower()
            inner = [[best]] if len(best) >= LEAST_NEEDLE else [n for n in map(needles, groups) if n]
            if not inner:
                return []
            out, runs, groups, at = out + inner[0], [""], [], at + 1
            continue
        token = pattern[at:_closed(pattern, at) + 1] if pattern[at] == "(" else _TOKEN.match(pattern, at)[0]
        at += len(token)
        times = _QUANTIFIER.match(pattern, at)
        at = times.end() if times else at
        char = token[1:] if re.fullmatch(r"\\[^A-Za-z0-9]", token) else token
        if token.startswith("(") and not times and not re.match(r"\(\?[^:]", token):
            groups.append(token[1:-1].removeprefix("?:"))
        if len(char) > 1 or not char.isascii() or token in (".", "^", "$") or times and times[0][0] in "?*{":
            runs.append("")
        else:
            runs[-1] += char
            runs += [""] if times else []
    return list(dict.fromkeys(out))


def may_hold(low: Column, pattern: str) -> Column:
    """Whether a lower-cased text has a literal that every match of a pattern has: much cheaper than the search itself."""
    any_of = F.lit(False)
    for x in needles(pattern):
        any_of = any_of | low.contains(x)
    return any_of if needles(pattern) else F.lit(True)


def found_in(text: Column, low: Column, pattern: str) -> Column:
    """Whether a pattern is found in a text, given its lower-cased form too; the search runs only where it may succeed."""
    return may_hold(low, pattern) & text.rlike(portable(pattern))


def _found(value: Column, pattern: str) -> Column:
    """Whether a pattern is found; one that can't do without an at sign is tried only where there is one."""
    plain = re.sub(r"\\.|\[[^\]]*\]", "", pattern)
    hit = value.rlike(portable(pattern))
    return value.contains("@") & hit if "@" in plain and not re.search(r"@[?*{]|[|()]", plain) else hit


def match(values: DataFrame, value: str, rows: list[tuple[str, str]]) -> DataFrame:
    """Every pair of a value and a rule (name, pattern) that its pattern finds, with ordinal and rule."""
    if len(rows) > MAX_RULES:
        raise ValueError(f"{len(rows)} rules; at most {MAX_RULES} fit a plan")
    found = [F.when(_found(F.col(value), p), F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("rule"))) for i, (n, p) in enumerate(rows)]
    return values.withColumn("__hit", F.explode(F.array_compact(F.array(*found)))).select(*values.columns, "__hit.ordinal", "__hit.rule")


def _product(i: int) -> Column:
    name, vendor, kind, *_ = catalog.PRODUCTS[i]
    return F.struct(F.lit(i).alias("rank"), F.lit(name).alias("product"), F.lit(vendor).alias("vendor"), F.lit(kind).alias("kind"))


def raw_products(files: DataFrame, raw: str = "raw", file: str = "path") -> DataFrame:
    """Products that the text of a file's bytes names, as medium evidence: file, rank, product, vendor, kind."""
    found = [F.when(found_in(F.col(raw), F.col("__low"), w), _product(i)) for i, (*_, w) in enumerate(catalog.PRODUCTS) if w]
    return files.withColumn("__low", F.lower(raw)).select(file, F.explode(F.array_compact(F.array(*found))).alias("p")).select(file, "p.*", F.lit("medium").alias("strength"))


def first_hits(hits: DataFrame, per: list[str], order: list[Column]) -> DataFrame:
    """The first hit by order for each combination of ``per``."""
    w = Window.partitionBy(*per).orderBy(*order)
    return hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def product_hits(tags: DataFrame, file: str = "path") -> DataFrame:
    """Products named in tags (file, key, value, ordinal of the tag): the first tag that names each.

    A name in a key that records the creating tool is strong evidence, in a free-text key medium.
    """
    usable = tags.where(~F.col("key").isin("xmp_history", "ai_parameters"))
    program = F.col("key").rlike(f"(?i)^(?:{catalog.PROGRAM_KEYS})$")
    value = F.col("value")
    named = [value.rlike(portable(r)) | (program & value.rlike(portable(p)) if p else F.lit(False)) for _, _, _, p, r, _ in catalog.PRODUCTS]
    found = F.explode(F.array_compact(F.array(*(F.when(n, _product(i)) for i, n in enumerate(named)))))
    hits = usable.select(file, "ordinal", "key", found.alias("p")).select(file, "ordinal", "key", "p.*")
    hits = first_hits(hits, [file, "product"], [F.col("ordinal")])
    strong = F.col("key").rlike(f"(?i)^(?:{catalog.TOOL_KEYS})$")
    return hits.select(file, "product", "vendor", "kind", "key", F.when(strong, "strong").otherwise("medium").alias("strength"), "rank")


def verdict(strengths: DataFrame, file: str = "path", strength: str = "strength") -> DataFrame:
    """Confidence for each file: confirmed by any strong evidence, likely by any medium, else none."""
    s = F.col(strength)
    agg = strengths.groupBy(file).agg(F.bool_or(s == "strong").alias("strong"), F.bool_or(s == "medium").alias("medium"), F.count(F.lit(1)).alias("n_evidence"))
    return agg.select(file, F.when(F.col("strong"), "confirmed").when(F.col("medium"), "likely").otherwise("none").alias("confidence"), "n_evidence")


def headline(hits: DataFrame, file: str = "path") -> DataFrame:
    """The product to name: strong hits before medium ones, then catalog order."""
    rank = F.struct(F.when(F.col("strength") == "strong", 0).otherwise(1), F.col("rank"))
    return hits.groupBy(file).agg(F.min_by("product", rank).alias("tool"), F.min_by("vendor", rank).alias("vendor"))


def device_products(models: DataFrame, model: str = "model") -> DataFrame:
    """Product of a model code: the exact code, else the first catalog code it starts with, case-insensitive."""
    rows = [(i, a, b, c, d) for i, (a, b, c, d, _) in enumerate(catalog.DEVICES)]
    d = models.sparkSession.createDataFrame(rows, "rank int, code string, product string, maker string, hardware string")
    clean = F.trim(F.col(model))
    m = models.join(F.broadcast(d), (clean == F.col("code")) | F.upper(clean).startswith(F.upper(F.col("code"))), "left")
    exact = F.when(clean == F.col("code"), 0).otherwise(1)
    return first_hits(m, [model], [exact, F.col("rank")]).select(model, "product", "maker", "hardware")
