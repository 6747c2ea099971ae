"""Links, intervals and tag maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing(refs: DataFrame, boxes: DataFrame, on: str) -> DataFrame:
    """References without a target."""
    return refs.join(boxes.select(on), on, "left_anti")


def gaps(spans: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """Half-open gaps between the spans of each key: a running maximum of the ends so far."""
    w = Window.partitionBy(key).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    s = spans.withColumn("gap_from", F.max(hi).over(w))
    return s.where(F.col("gap_from") < F.col(lo)).select(key, "gap_from", F.col(lo).alias("gap_to"))


def cover(points: DataFrame, at: str, spans: DataFrame, lo: str, hi: str, width: int) -> DataFrame:
    """Points within spans: both sides are dealt to buckets of ``width``, so the range join is an equi join."""
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    s = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return p.join(s, "__b").where(F.col(at).between(F.col(lo), F.col(hi))).drop("__b")


def cover_counts(points: DataFrame, at: str, spans: DataFrame, key: str, lo: str, hi: str, width: int) -> DataFrame:
    """key, n: how many points each key's spans cover (both ends included), keys that cover any.

    No pairs are made: equal points and equal spans are grouped, and in each bucket of ``width`` a running count of the
    points is read before a span's start and after its end.
    """
    p = points.groupBy(F.col(at).alias("__at")).agg(F.count(F.lit(1)).alias("__n")).where("__at IS NOT NULL")
    p = p.select(F.floor(F.col("__at") / width).alias("__b"), "__at", F.lit(0).alias("__side"), "__n", *(F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in (lo, hi)))
    first, last = (F.floor(F.col(c) / width) for c in (lo, hi))
    parts = spans.where(F.col(lo) <= F.col(hi)).select(lo, hi).distinct().withColumn("__b", F.explode(F.sequence(first, last)))
    end = F.when(F.col("__b") == last, F.col(hi)).otherwise((F.col("__b") + 1) * width)
    sides = F.array(F.when(F.col("__b") == first, F.struct(F.col(lo).alias("__at"), F.lit(-1).alias("__side"))), F.struct(end.alias("__at"), F.lit(1).alias("__side")))
    ends = parts.withColumn("__e", F.explode(F.array_compact(sides))).select("__b", "__e.*", F.lit(0).cast("bigint").alias("__n"), lo, hi)
    w = Window.partitionBy("__b").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    told = p.unionByName(ends).withColumn("__c", F.sum("__n").over(w)).where("__side <> 0")
    n = told.groupBy(lo, hi).agg(F.sum(F.col("__c") * F.col("__side")).alias("n")).where("n > 0")
    return spans.join(n, [lo, hi]).groupBy(key).agg(F.sum("n").alias("n"))


def flatten(df: DataFrame, key: str, json: str) -> DataFrame:
    """key, tag, value of the entries of a JSON object column, values as text."""
    entries = F.from_json(json, "map<string,string>")
    return df.select(key, F.explode(entries).alias("tag", "value"))


def unpivot(df: DataFrame, key: str, category: str, columns: list[str]) -> DataFrame:
    """key, category, property, value rows of scalar columns, for a flat report."""
    return df.select(key, *(F.col(c).cast("string").alias(c) for c in columns)).unpivot(key, columns, "property", "value").withColumn("category", F.lit(category))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the last by order: the union of maps whose right side wins."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def search(df: DataFrame, columns: list[str], words: str) -> DataFrame:
    """Rows in which some column contains the words, whatever the case."""
    hit: Column = F.lit(False)
    for c in columns:
        hit |= F.coalesce(F.lower(F.col(c)).contains(words.lower()), F.lit(False))
    return df.where(hit)
