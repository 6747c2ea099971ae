"""Registry of queries: a Spark callable and, where SQL can express it, its DuckDB form."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, columns: str, rows: list[str]) -> DataFrame:
    """A small relation from SQL row literals; ``inline_sql`` gives the same relation to the oracle."""
    return spark.sql(f"SELECT * FROM {inline_sql(columns, rows)}")


def inline_sql(columns: str, rows: list[str]) -> str:
    return f"(VALUES {', '.join(rows)}) AS t({columns})"


_FIRST = re.compile(r"\(\s*('(?:[^']|'')*'|[^,)]+)")


def _grouped(columns: str, rows: list[str]) -> tuple[str, int, str, bool]:
    """Row literals with the number of their group (rows of the same first column) before them: columns, groups, values,
    and whether the first column is text."""
    firsts = [_FIRST.match(r)[1] for r in rows]
    number = {x: i for i, x in enumerate(dict.fromkeys(firsts))}
    values = ", ".join(f"({number[f]}, {r[1:]}" for f, r in zip(firsts, rows))
    return f"deal, of_{columns}", len(number), values, firsts[0].startswith("'")


def dealt(spark: SparkSession, sf_dir: str, columns: str, rows: list[str]) -> DataFrame:
    """The documents, each with one group of row literals, dealt by doc_id; the first column becomes the doc_id.

    The literals are a few constant rows of the query itself, so they may be broadcast whatever the table's size.
    """
    names, n, values, text = _grouped(columns, rows)
    first, *rest = columns.split(", ")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % n).alias("deal"))
    found = docs.join(F.broadcast(spark.sql(f"SELECT * FROM (VALUES {values}) AS t({names})")), "deal")
    return found.select((F.col("doc_id").cast("string") if text else F.col("doc_id")).alias(first), *rest)


def dealt_sql(columns: str, rows: list[str]) -> str:
    names, n, values, text = _grouped(columns, rows)
    first, *rest = columns.split(", ")
    key = "CAST(doc_id AS VARCHAR)" if text else "doc_id"
    return f"(SELECT {', '.join([f'{key} AS {first}', *rest])} FROM documents JOIN (VALUES {values}) AS l({names}) ON deal = doc_id % {n}) AS t"
