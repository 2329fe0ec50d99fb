"""Chat formatting by perspective rotation.

A dialogue is rendered once for every participant: that speaker is the assistant, the others are users with their names, and only
the assistant's words are trained on. Output is one segment per turn with its place in the rendering, so that a rendering is never
gathered in one row or task. Turns are cut by range into partitions of even size; a table of lengths per (partition, conversation,
participant) carries places over the cuts, as long conversations may lie in several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.session import materialize

# Marks around a turn, roles of the rendering, and the speaker of turns without a role
START, END = "<|im_start|>", "<|im_end|>"
SYSTEM, ASSISTANT, USER, NOBODY = "system", "assistant", "user", "unknown"


def _escaped(text: Column) -> Column:
    """Marks inside a text are split by a blank, so that they stay text."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, speaker, turn, segment, seg_start, seg_end, mask_start, mask_end``: a row per turn and participant.

    Places count code points from 0, ends are exclusive; the mask covers the words and the end mark of the assistant's turns and is
    null elsewhere. Participants are the roles of a conversation but ``system``, which is rendered as it is for all; a
    conversation of system turns only has no rendering. A null or empty role is the speaker ``unknown``; a null text is empty; a null
    conversation is one of its own. Turns are in order of turn (null first), role and text; repeated turns are all rendered.
    Other columns are not read; an empty table gives an empty one.
    """
    name = F.coalesce(F.nullif(F.col(role).cast("string"), F.lit("")), F.lit(NOBODY))
    rows = turns.select(
        F.col(conv).alias("_conv"), F.col(turn).cast("long").alias("_turn"), name.alias("_name"), _escaped(F.col(text)).alias("_text")
    )
    order = ["_conv", "_turn", "_name", "_text"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed).withColumn("_part", F.shiftright("_at", 33))
    people = placed.filter(F.col("_name") != SYSTEM).select(F.col("_conv").alias("_of"), F.col("_name").alias("_speaker")).distinct()
    seen = placed.join(people, F.col("_conv").eqNullSafe(F.col("_of"))).drop("_of")
    own = F.col("_name") == F.col("_speaker")
    head = F.when(F.col("_name") == SYSTEM, SYSTEM).when(own, ASSISTANT).otherwise(
        F.concat(F.lit(USER + " name="), _escaped(F.col("_name")))
    )
    seen = seen.withColumn("_head", F.concat(F.lit(START), head, F.lit("\n")))
    seen = seen.withColumn("_segment", F.concat("_head", "_text", F.lit(END + "\n")))
    seen = seen.withColumn("_size", F.length("_segment").cast("long"))

    keys = ["_conv", "_speaker", "_part"]
    sums = seen.groupBy(*keys).agg(F.sum("_size").alias("_sum"))
    earlier = W.partitionBy("_conv", "_speaker").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carry = sums.select(*[F.col(k).alias(f"{k}2") for k in keys], F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = W.partitionBy(*keys).orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    seen = seen.withColumn("_upto", F.sum("_size").over(within))
    match = F.col("_conv").eqNullSafe(F.col("_conv2")) & (F.col("_speaker") == F.col("_speaker2")) & (F.col("_part") == F.col("_part2"))
    end = F.col("_before") + F.col("_upto")
    start = end - F.col("_size")
    return seen.join(carry, match).select(
        F.col("_conv").alias(conv), F.col("_speaker").alias("speaker"), F.col("_turn").alias(turn), F.col("_segment").alias("segment"),
        start.alias("seg_start"), end.alias("seg_end"),
        F.when(own, start + F.length("_head")).alias("mask_start"), F.when(own, end - 1).alias("mask_end"),
    )


SQL = """
with rows as (
  select conv_id, turn, coalesce(nullif(role, ''), 'unknown') name, replace(coalesce(text, ''), '<|im_', '<| im_') text from conversations
), people as (
  select distinct conv_id, name speaker from rows where name <> 'system'
), heads as (
  select rows.*, speaker, '<|im_start|>' || case when name = 'system' then 'system' when name = speaker then 'assistant'
    else 'user name=' || replace(name, '<|im_', '<| im_') end || chr(10) head
  from rows join people on rows.conv_id is not distinct from people.conv_id
), segments as (
  select *, head || text || '<|im_end|>' || chr(10) segment from heads
), placed as (
  select *, sum(length(segment)) over (partition by conv_id, speaker order by turn nulls first, name, text
    rows between unbounded preceding and current row)::bigint seg_end from segments
)
select conv_id, speaker, turn, sha256(segment) segment_sha256, seg_end - length(segment) seg_start, seg_end,
  case when name = speaker then seg_end - length(segment) + length(head) end mask_start, case when name = speaker then seg_end - 1 end mask_end
from placed
"""
