"""A training-data pipeline over documents: each stage keeps or changes rows, the last weighs them.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents.
Between stages the result is written as Parquet and read again, so when a stage starts, the scratch tables of
the stage before it are no longer needed and go: run() owns those of its stages, and stages that are called on
their own share an owner a thread.  Those of other queries aren't touched.  Stages run Spark jobs as they plan.

Every stage: an empty table gives an empty result; columns other than those of documents are dropped; rows that
repeat others are documents of their own unless the stage says otherwise.
"""

from __future__ import annotations

import functools
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refract.llm.common import Scratch, delete, materialise, shared_folder
from refract.llm.decontaminate import contaminated
from refract.llm.jaccard_join import near_duplicates, text_key
from refract.llm.language_id import UNDETERMINED, fit, identify
from refract.llm.mixing import mix_sources
from refract.llm.substring_dedup import dedup_substrings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of the low score of a language's learned documents below which it isn't told.
LEAST_SCORE = 0.5

_threads = threading.local()


def _stage(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
        if scratch is None:
            scratch = _threads.scratch = getattr(_threads, "scratch", None) or Scratch()
        scratch.delete(spark)
        with scratch:
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told from their text.

    Rejected: null and letterless texts, and texts that score under half of what the least certain fiftieth of a
    language's learned documents score: they share next to no n-grams with it.
    * where nothing can be learned (no lang, no lettered text) all lettered texts stay;
    * null doc_id, lang or source: judged by the text like others; repeated rows are judged alike.
    """
    own = docs.select(*COLUMNS)
    model = fit(own)
    if model is None:
        return own.where(F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    told = identify(own, ("text", "lang", "source", "n_chars"), model)
    low = F.create_map(*(F.lit(x) for name, score in model.low.items() for x in (name, LEAST_SCORE * score)))
    return told.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= F.try_element_at(low, "lang_pred"))).select(*COLUMNS)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each connected group of near copies, of the smallest doc_id and text.

    * rows without an id or words stay;
    * of exactly repeated rows one stays; rows that repeat an id with other texts are judged by their own text;
    * ties of doc_id go to the smaller text key.
    """
    keys = ["doc_id", "text_key"]
    found = near_duplicates(docs.select("doc_id", "text")).where("doc_id IS NOT NULL AND n_shingles > 0")
    counted = materialise(found.groupBy(*keys).agg(F.first("first").alias("first"), F.count(F.lit(1)).alias("n")).where("NOT first OR n > 1"), "copies")
    keyed = docs.select(*COLUMNS).withColumn("text_key", text_key("text"))
    rest = keyed.join(counted, keys, "left_anti")
    repeated = counted.where("first")
    if not repeated.isEmpty():
        rest = rest.unionByName(keyed.join(repeated, keys, "left_semi").dropDuplicates(keys))
    return rest.select(*COLUMNS)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word passages that a smaller doc_id has; a document that loses all words goes.

    * rows that lose nothing keep their text as it is, null texts too; others get their kept words, joined by
      one space, and the new n_chars;
    * null doc_id: kept whole; rows that repeat an id are judged against smaller ids only.
    """
    cut = dedup_substrings(docs.select("doc_id", "text")).where("n_removed > 0").select(F.col("doc_id").alias("of"), F.col("cls").alias("of_cls"), "kept_text").dropDuplicates(["of", "of_cls"])
    cls = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    joined = docs.select(*COLUMNS).withColumn("cls", cls).join(cut, (F.col("doc_id") == F.col("of")) & (F.col("cls") == F.col("of_cls")), "left")
    text = F.when(F.col("of").isNull(), F.col("text")).otherwise(F.col("kept_text"))
    n = F.when(F.col("of").isNull(), F.col("n_chars")).otherwise(F.char_length("kept_text").cast("long"))
    return joined.where("of IS NULL OR kept_text <> ''").select("doc_id", text.alias("text"), "lang", "source", n.alias("n_chars"))


@_stage
def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    * null doc_id or text: kept; rows that repeat an id are judged by their own text; repeated rows go alike.
    """
    leaks = contaminated(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), by_text=True)
    keyed = docs.select(*COLUMNS).withColumn("text_key", F.xxhash64("text"))
    return keyed.join(leaks.select("doc_id", "text_key").distinct(), ["doc_id", "text_key"], "left_anti").select(*COLUMNS)


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document; null source is a source, null text has size 0."""
    return mix_sources(docs.select("doc_id", "source", "text"))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("benchmark_items", benchmark_items),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; only the last stage's table is left when it returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before, scratch = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None, Scratch()
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir, scratch).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    scratch.delete(spark)
    return docs


#: The mix draws at random and language ID is learned: SQL can't express them.
ORACLE_SQL = None
