"""Files as rows: binary scan, extension and format; ranges of bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.forensics import format_of

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the name, the whole name without one."""
    return F.lower(F.substring_index(F.substring_index(path, "/", -1), ".", -1))


def with_format(files: DataFrame) -> DataFrame:
    e = extension(F.col("path"))
    return files.withColumn("extension", e).withColumn("format", format_of(F.col("content"), e))


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row a file under path; a filter on path or length prunes files before they are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return with_format((reader.option("pathGlobFilter", glob) if glob else reader).load(path))


def byte_range(content: Column, first: Column | int, last: Column | int) -> Column:
    """Bytes first .. last of a ``Range`` request, both included."""
    lo, hi = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    return F.substring(content, (lo + 1).cast("int"), (hi - lo + 1).cast("int"))
