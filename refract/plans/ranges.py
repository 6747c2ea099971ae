"""Queries over byte ranges: requests that are dealt to documents, and files that Spark writes from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..registry import query, table
from ..sources.files import byte_range
from ..sources.ranges import answer, byte_ranges
from ..sources.scratch import folder

_LO = "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE doc_id * 37 % 600 END"
_HI = "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN doc_id % 90 WHEN 2 THEN NULL ELSE doc_id * 37 % 600 + doc_id % 7 * 40 - 20 END"


@query(f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST({_LO} AS BIGINT) AS a, CAST({_HI} AS BIGINT) AS b FROM documents),
r AS (SELECT *, length(h) // 2 AS n, CASE WHEN a IS NULL THEN greatest(0, length(h) // 2 - b) ELSE a END AS lo, CASE WHEN a IS NULL OR b IS NULL THEN length(h) // 2 - 1 ELSE least(b, length(h) // 2 - 1) END AS hi FROM d),
s AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN 200 WHEN lo >= n OR lo > hi OR (a IS NULL AND b <= 0) THEN 416 ELSE 206 END AS status FROM r)
SELECT doc_id, CAST(status AS INT) AS status, CASE status WHEN 206 THEN 'bytes ' || lo || '-' || hi || '/' || n WHEN 416 THEN 'bytes */' || n END AS told,
CASE status WHEN 200 THEN sha256(unhex(h)) WHEN 206 THEN sha256(unhex(substr(h, CAST(2 * lo + 1 AS INT), CAST(2 * (hi - lo + 1) AS INT)))) END AS sha256 FROM s""")
def range_answers(spark, d):
    """Answers to range requests on the texts: whole, the last n bytes, from, from to, and past the end."""
    t = table(spark, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("c"), F.expr(_LO).cast("bigint").alias("a"), F.expr(_HI).cast("bigint").alias("b"))
    t = t.withColumn("r", answer(F.octet_length("c"), F.col("a"), F.col("b")))
    return t.select("doc_id", "r.status", "r.told", F.when(F.col("r.status") < 400, F.sha2(byte_range(F.col("c"), F.col("r.first"), F.col("r.last")), 256)).alias("sha256"))


@query("""SELECT CAST(instr('0123456789ABCDEF', p[1]) * 16 + instr('0123456789ABCDEF', p[2]) - 17 AS INT) AS byte, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(hex(encode(coalesce(text, '') || chr(10))), '..')) AS p FROM documents) x GROUP BY p""")
def range_histogram(spark, d):
    """Bytes of the text files that Spark writes of the documents, read in pieces of 64 KiB through the range source."""
    path = folder(spark, "texts")
    table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.text(path)

    def count(batches):
        for batch in batches:
            total = np.zeros(256, np.int64)
            for x in batch.column("content"):
                total += np.bincount(np.frombuffer(x.as_py(), np.uint8), minlength=256)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["byte", "n"])

    pieces = byte_ranges(spark, path, 1 << 16, "*.txt").where(F.col("length") > 0)
    return pieces.select("content").mapInArrow(count, "byte int, n bigint").groupBy("byte").agg(F.sum("n").alias("n"))
