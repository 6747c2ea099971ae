"""Files as they arrive: the same operators on micro-batches of a directory stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ai_origin, media, rules
from ..sources.containers import boxes
from ..sources.files import SCHEMA, with_format


def arriving_files(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """An unbounded table of the files that appear under path."""
    stream = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").load(path)
    return with_format(stream)


def inspect_arrivals(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write boxes, tags and product hits of arriving files under ``out`` until all that is there is done.

    A batch is written under its number, so a batch that is run again after a failure replaces itself.
    """

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        found = boxes(batch)
        tags = media.tags(found)
        for name, df in (("boxes", found.drop("payload")), ("tags", tags), ("products", rules.product_hits(tags))):
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        batch.unpersist()

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_files(files: DataFrame, horizon: str | None = None) -> DataFrame:
    """Arriving files with ``digest``, without those whose bytes have arrived before, under whatever name.

    What has been seen is keyed state of the query, so it outlives restarts.  ``horizon`` bounds it: digests older than
    that behind the newest modification time are forgotten, and their files count as new again.
    """
    told = files.where("content IS NOT NULL").withColumn("digest", F.sha2("content", 256))
    if horizon is None:
        return told.dropDuplicates(["digest"])
    return told.withWatermark("modificationTime", horizon).dropDuplicatesWithinWatermark(["digest"])


def judge_arrivals(files: DataFrame, out: str, checkpoint: str, horizon: str | None = None) -> StreamingQuery:
    """Write one AI verdict for each content that arrives, once, until all that is there is done.

    State and progress are committed together, and a batch that is run again replaces what it wrote: a replay, whole or
    from the middle, gives the same table.
    """

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        tags = media.tags(boxes(batch))
        found = ai_origin.analyse(batch.withColumn("raw", ai_origin.raw_text(F.col("content"))), tags)
        found.join(batch.select("path", "digest"), "path").write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.unpersist()

    return new_files(files, horizon).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
