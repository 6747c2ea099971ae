"""Choices that a report makes: when and by which model a file was made, hints, visible tags, audio support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog
from .rules import portable

# Where a creation time is looked for, in order, and what the source is called.
CREATED = [
    ("CreateDate", "XMP CreateDate"), ("DateTimeOriginal", "EXIF original date"), ("creation_time", "File creation tag"), ("Creation Time", "PNG creation time"), ("date", "Date tag"), ("year", "Audio date tag"),
    ("bext_origination_date", "Broadcast Wave date"), ("ModifyDate", "Last modified tag"), ("modification_time", "Last modified tag"),
]
# Tags that aren't shown.
HIDDEN = ("xmp_history", "ai_parameters", "ai_prompt", "prompt", "workflow", "parameters", "UserComment")


def tag(tags: Column, key: str) -> Column:
    return F.nullif(F.try_element_at(tags, F.lit(key)), F.lit(""))


def created(tags: Column) -> Column:
    """struct(value, source): the first creation time that the tags have."""
    return F.coalesce(*(F.when(tag(tags, k).isNotNull(), F.struct(tag(tags, k).alias("value"), F.lit(s).alias("source"))) for k, s in CREATED))


def model_name(text: Column) -> Column:
    """The first model name, by order of the patterns, that a text mentions."""
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(text, portable(p), 0)), F.lit("")) for p in catalog.MODEL_PATTERNS))


def script_hints(programs: Column) -> Column:
    """Programs of the catalog that a text of program names mentions."""
    found = [F.when(programs.rlike(portable(p)), F.lit(n)) for p, n in catalog.SCRIPT_GENERATORS]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def size_hint(width: Column, height: Column, has_camera: Column) -> Column:
    """A weak hint: both sides multiples of 64, 512 wide at least, no camera."""
    return F.coalesce((width >= 512) & (width % 64 == 0) & (height % 64 == 0) & ~has_camera, F.lit(False))


def visible(tags: Column) -> Column:
    return F.map_filter(tags, lambda k, v: ~k.isin(*HIDDEN) & F.coalesce(v != "", F.lit(False)))


def label(key: Column) -> Column:
    """A readable name of a tag key: words with capitals."""
    return F.initcap(F.trim(F.regexp_replace(F.replace(key, F.lit("_"), F.lit(" ")), "([a-z])([A-Z])", "$1 $2")))


def tag_maps(tags: DataFrame) -> DataFrame:
    """path, tags: rows of (path, ordinal, key, value) as one map a file; of equal keys the first counts."""
    first = tags.groupBy("path", "key").agg(F.min_by("value", "ordinal").alias("value"))
    return first.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("tags"))


def report_csv(rows: DataFrame) -> DataFrame:
    """Category, Property, Value rows of (path, format_name, size, tags), ready for a quoted CSV writer."""
    plain = rows.select("path", F.lit("Format").alias("Category"), F.explode(F.create_map(F.lit("format_name"), F.col("format_name"), F.lit("size"), F.col("size").cast("string"))).alias("Property", "Value"))
    return plain.union(rows.select("path", F.lit("Tag"), F.explode("tags")))


def report_json(rows: DataFrame) -> DataFrame:
    """path, json: one pretty JSON text a file."""
    return rows.select("path", F.to_json(F.struct(*[c for c in rows.columns]), {"pretty": "true"}).alias("json"))
