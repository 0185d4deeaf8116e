"""Preference formatting: one prompt, two masked completions.

A pair is two conversations under one id.  The prompt is their longest common
prefix of turns (same number, role and text) and is rendered once; what
follows is the chosen and the rejected completion.  In completions the
assistant's turns are trained on, all else is masked.

The prefix ends at the first turn that differs, found by a join on (pair,
turn) and a minimum, so conversations are never gathered: the result is one
row per rendered turn with its character offset within its part.  Offsets come
from global prefix sums, so a pair with very many turns is no hot spot.

Turns without a pair or turn number belong to no conversation and are left
out; null role and text render as empty; of turns that repeat a number the
smallest (role, text) counts; a pair without difference has a prompt only; an
empty table gives no rows.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.llm.common import running_totals

PARTS = {"prompt": 0, "chosen": 1, "rejected": 2}


def _turns(df: DataFrame) -> DataFrame:
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return df.where("pair_id is not null and turn is not null").groupBy("pair_id", "turn").agg(F.min(said).alias("said"))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, part, turn, role, segment, start, trained; inputs have pair_id, turn, role, text."""
    both = _turns(chosen).select("pair_id", "turn", F.col("said").alias("yes")).join(
        _turns(rejected).select("pair_id", "turn", F.col("said").alias("no")), ["pair_id", "turn"], "full")
    same = F.col("yes").eqNullSafe(F.col("no"))
    first = both.groupBy("pair_id").agg(F.min(F.when(~same, F.col("turn"))).alias("first"))
    rows = both.join(first, "pair_id")
    shared = F.coalesce(F.col("turn") < F.col("first"), F.lit(True))
    made = rows.select("pair_id", "turn", F.explode(F.when(shared, F.array(
        F.struct(F.lit("prompt").alias("part"), F.col("yes").alias("said")))).otherwise(F.array(
            F.struct(F.lit("chosen").alias("part"), F.col("yes").alias("said")),
            F.struct(F.lit("rejected").alias("part"), F.col("no").alias("said"))))).alias("x"))
    made = made.where("x.said is not null").select("pair_id", "x.part", "turn", "x.said.role", "x.said.text")
    segment = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n"))
    made = made.select("pair_id", "part", "turn", "role", segment.alias("segment"),
                       ((F.col("part") != "prompt") & (F.col("role") == "assistant")).alias("trained"))
    made = made.withColumn("_len", F.length("segment").cast("long"))
    placed = running_totals(made, [F.col("pair_id"), F.col("part"), F.col("turn")], {"chars": "_len"}, "pairs")
    begins = placed.groupBy(F.col("pair_id").alias("_p"), F.col("part").alias("_q")).agg(F.min("before_chars").alias("_b"))
    return placed.join(begins, (F.col("pair_id") == F.col("_p")) & (F.col("part") == F.col("_q"))).select(
        "pair_id", "part", "turn", "role", "segment", (F.col("before_chars") - F.col("_b")).alias("start"), "trained")


def contrasted(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected conversations from plain ones (conv_id, turn, role, text).

    The rejected side answers the last assistant turn with the last assistant
    turn of the next conversation, by ascending id and round to the first.
    Conversations without an assistant turn make no pair."""
    turns = _turns(conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")).select(
        "pair_id", "turn", "said.role", "said.text")
    answers = turns.where("role = 'assistant'")
    last = answers.groupBy("pair_id").agg(F.max("turn").alias("turn"))
    ring = running_totals(last, [F.col("pair_id")], {}, "ring").join(answers, ["pair_id", "turn"]).select(
        "pair_id", "turn", "text", "before_rows", "total_rows")
    following = ring.select(F.expr("(before_rows + total_rows - 1) % total_rows").alias("before_rows"),
                            F.col("text").alias("other"))
    swap = ring.join(following, "before_rows").select(F.col("pair_id").alias("_p"), F.col("turn").alias("_t"), "other")
    chosen = turns.join(swap, F.col("pair_id") == F.col("_p"))
    swapped = F.when(F.col("turn") == F.col("_t"), F.col("other")).otherwise(F.col("text"))
    return (chosen.select("pair_id", "turn", "role", "text"),
            chosen.select("pair_id", "turn", "role", swapped.alias("text")))
