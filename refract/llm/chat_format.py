"""Chat formatting by perspective rotation, in DataFrame functions only.

A conversation is rendered once for each participant.  In that rendering the participant's turns are the
assistant's and carry the training mask, everybody else speaks as a user under their own name, and system
turns stay system turns.  The unit is the message, so a conversation of any length is never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = "system"
UNNAMED = "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _plain(text: Column) -> Column:
    """Text that can't forge a marker: ``<|`` gets a space."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """One row for each message and participant (a role other than system) of its conversation.

    Columns: conv_id, perspective, turn, role (system, assistant or user), name (of a user), content,
    segment (the rendered message; a dialogue is its segments by turn), mask (1 on the participant's own
    turns), mask_from and mask_to (code points of the segment that are trained on; equal where mask is 0).

    * null role: the name ``unknown``; null text: empty; null turn: kept; null conv_id: one conversation;
    * repeated rows are repeated messages; a conversation of system turns only has no participant, no rows;
    * ``<|`` in a text or name is written ``< |``; other columns are not read; an empty table gives no rows.
    """
    t = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(UNNAMED)).alias("speaker"),
        _plain(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("content"),
    )
    cast = t.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    rows = t.join(cast, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    mine, system = F.col("speaker") == F.col("perspective"), F.col("speaker") == SYSTEM
    role = F.when(system, SYSTEM).when(mine, "assistant").otherwise("user")
    name = F.when(~mine & ~system, _plain(F.col("speaker")))
    head = F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    begin = F.char_length(head).cast("long")
    # The end marker is trained on too: the model has to learn when to stop.
    end = F.when(mine & ~system, begin + F.char_length(F.concat("content", F.lit(CLOSE)))).otherwise(begin)
    return rows.select(
        "conv_id", "perspective", "turn", role.alias("role"), name.alias("name"), "content",
        F.concat(head, "content", F.lit(CLOSE)).alias("segment"),
        F.when(mine & ~system, 1).otherwise(0).alias("mask"), begin.alias("mask_from"), end.alias("mask_to"),
    )


#: DuckDB form over the table conversations.
ORACLE = f"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '{UNNAMED}') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS content
  FROM conversations),
people AS (SELECT DISTINCT conv_id AS of_conv, speaker AS perspective FROM t WHERE speaker <> '{SYSTEM}'),
r AS (
  SELECT conv_id, perspective, turn, content,
         CASE WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
         CASE WHEN speaker <> perspective AND speaker <> '{SYSTEM}' THEN replace(speaker, '<|', '< |') END AS name,
         CASE WHEN speaker = perspective THEN 1 ELSE 0 END AS mask
  FROM t JOIN people ON conv_id IS NOT DISTINCT FROM of_conv),
h AS (SELECT *, '{OPEN}' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM r)
SELECT conv_id, perspective, turn, role, name, content, head || content || '<|im_end|>' || chr(10) AS segment, mask,
       CAST(length(head) AS BIGINT) AS mask_from,
       CAST(length(head) + CASE WHEN mask = 1 THEN length(content) + 11 ELSE 0 END AS BIGINT) AS mask_to
FROM h
"""
