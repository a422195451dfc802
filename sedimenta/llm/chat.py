"""Preference formatting with DataFrame functions alone.

The longest common turn prefix of a chosen and a rejected conversation is rendered once as the prompt;
what follows on either side is its completion, in which only the assistant's turns are trained on.
Results are segments, a row for each turn; no conversation becomes one value. The turns of a pair go through
one exchange, by pair, and all windows use it: they read a pair's turns in order in one task, which spills
what does not fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rendered(role: Column, text: Column) -> Column:
    """A turn between markers; marker openings inside are broken with a space."""
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|turn|>"), safe(role), F.lit("\n"), safe(text), F.lit("<|end|>\n"))


def preference_segments(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", trained_role: str = "assistant") -> DataFrame:
    """(pair_id, part, pos, role, segment, trained, start) of every pair; both inputs have the columns
    pair, turn, role and text.

    part: prompt, chosen or rejected; pos: the turn's place from 1 in its conversation; start: characters
    of the part before it; trained: the mask. Turns are equal if role and text are (nulls equal nulls).
    A pair that only one side has is all completion. Turns of a null pair belong to none and are left
    out. Null roles and texts render as empty. Turns of one number go by role and text, repeated ones
    stay. Other columns are ignored; empty tables give none."""
    side = lambda df, i: df.select(F.col(pair).alias("pair_id"), F.lit(i).alias("side"), "turn", "role", "text")
    rows = side(chosen, 0).unionByName(side(rejected, 1)).where("pair_id is not null")
    return _segments(rows.repartition("pair_id"), trained_role)


def _segments(rows: DataFrame, trained_role: str) -> DataFrame:
    """The segments of rows (pair_id, side, turn, role, text) that are partitioned by pair_id."""
    placed = rows.withColumn("pos", F.row_number().over(Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")).cast("long"))
    beside = Window.partitionBy("pair_id").orderBy("pos", "side")  # the turns of one place follow each other
    turn = F.struct("pos", "role", "text")
    both = placed.withColumn("alike", F.when(F.col("side") == 0, F.lead(turn).over(beside).eqNullSafe(turn)).otherwise(F.lag(turn).over(beside).eqNullSafe(turn)))
    both = both.withColumn("common", F.min(F.col("alike").cast("int")).over(Window.partitionBy("pair_id").orderBy("pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)) == 1)
    part = F.when(F.col("common"), "prompt").when(F.col("side") == 0, "chosen").otherwise("rejected")
    out = both.where("side = 0 or not common").withColumns({"part": part, "segment": rendered(F.col("role"), F.col("text"))})
    prior = Window.partitionBy("pair_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    trained = (F.col("part") != "prompt") & F.col("role").eqNullSafe(F.lit(trained_role))
    return out.select("pair_id", "part", "pos", "role", "segment", trained.alias("trained"), F.coalesce(F.sum(F.length("segment").cast("long")).over(prior), F.lit(0).cast("long")).alias("start"))


def reply_segments(turns: DataFrame, id_col: str = "conv_id", trained_role: str = "assistant") -> DataFrame:
    """preference_segments of pairs made from conversations. Chosen: every conversation up to its last reply by
    the assistant. Rejected: the same with the last reply of the conversation of the next id in that place;
    none if there is no such reply. Null ids are left out."""
    turns = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("pair_id"), "turn", "role", "text")
    replied = (F.col("role") == "assistant") & F.col("turn").isNotNull()
    final = turns.where(replied).groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("m"))
    other = final.select((F.col("pair_id") - 1).alias("pair_id"), F.struct(F.col("m.text").alias("text")).alias("foreign"))
    last = F.max(F.when(replied, F.col("turn"))).over(Window.partitionBy("pair_id"))
    upto = turns.repartition("pair_id").withColumn("last", last).where("turn < last or (turn is null and last is not null) or (turn = last and role = 'assistant')")
    swapped = F.when((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), F.col("foreign.text")).otherwise(F.col("text"))
    side = lambda i, text: F.struct(F.lit(i).alias("side"), text.alias("text"))
    sides = F.when(F.col("foreign").isNull(), F.array(side(0, F.col("text")))).otherwise(F.array(side(0, F.col("text")), side(1, swapped)))
    rows = upto.join(other, "pair_id", "left").select("pair_id", "turn", "role", F.inline(sides))
    return _segments(rows, trained_role)
