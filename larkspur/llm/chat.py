"""Preference formatting. DataFrame functions only.

Two conversations of a pair, one chosen and one rejected, share a prefix of turns (equal role and text). The
longest such prefix is rendered once as the prompt; what follows in each is its completion, with the spans of
characters that a trainer learns from: the text and end mark of assistant turns. All else is masked.

Turns are rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``.

Edge cases: null roles and texts are empty strings, equal to each other; turns with equal number are ordered
by role and text; turns of null number come first; rows without a conversation id belong to none; a pair
that lacks a side has ``paired`` false, no completion for it, and no prompt; equal conversations have empty completions;
empty tables give empty results. One output row is one pair, so a pair has to fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, AFTER_ROLE, END, AFTER = "<|im_start|>", "\n", "<|im_end|>", "\n"


def _sides(turns: DataFrame, pair: Column, is_chosen: Column, turn: str, role: str, text: str) -> DataFrame:
    t = turns.select(pair.alias("pair_id"), is_chosen.alias("ok"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # where each turn starts when rendered; the window and the groups share one shuffle
    before = W.partitionBy("pair_id", "ok").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("role") + F.length("text") + F.lit(len(START + AFTER_ROLE + END + AFTER))).over(before), F.lit(0)).cast("int")
    return (
        t.where("pair_id IS NOT NULL AND ok IS NOT NULL")
        .repartition("pair_id")
        .select("pair_id", "ok", F.struct("turn", "role", "text", at.alias("at")).alias("t"))
        .groupBy("pair_id")
        .agg(F.sort_array(F.collect_list(F.when(F.col("ok"), F.col("t")))).alias("c"), F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("t")))).alias("r"))
    )


def _rendered(turns: str) -> str:
    return f"array_join(transform({turns}, t -> concat('{START}', t.role, '\\n', t.text, '{END}\\n')), '')"


def _mask(turns: str, learn: str) -> str:
    """Spans [start, end) of the rendered turns that are learnt from, counted from the first of them."""
    head = f"t.at - get({turns}, 0).at + {len(START) + len(AFTER_ROLE)} + length(t.role)"
    return f"transform(filter({turns}, t -> t.role = '{learn}'), t -> named_struct('start', {head}, 'end', {head} + length(t.text) + {len(END)}))"


def preference_pairs(turns: DataFrame, pair: Column, is_chosen: Column, turn="turn", role="role", text="text", learn: str = "assistant") -> DataFrame:
    """pair_id, paired, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask (arrays of start, end): a row per pair."""
    d = _sides(turns, pair, is_chosen, turn, role, text)
    d = d.withColumn("paired", F.expr("size(c) > 0 AND size(r) > 0"))
    d = d.withColumn("k", F.expr("CASE WHEN paired THEN aggregate(sequence(0, least(size(c), size(r))), 0, (a, i) -> CASE WHEN a = i AND get(c, i).role = get(r, i).role AND get(c, i).text = get(r, i).text THEN a + 1 ELSE a END) ELSE 0 END"))
    d = d.withColumn("head", F.expr("slice(c, 1, k)")).withColumn("c", F.expr("slice(c, k + 1, greatest(size(c) - k, 0))")).withColumn("r", F.expr("slice(r, k + 1, greatest(size(r) - k, 0))"))
    return d.select(
        "pair_id",
        "paired",
        F.col("k").cast("long").alias("n_prompt_turns"),
        F.expr(_rendered("head")).alias("prompt"),
        F.expr(_rendered("c")).alias("chosen"),
        F.expr(_rendered("r")).alias("rejected"),
        F.expr(_mask("c", learn)).alias("chosen_mask"),
        F.expr(_mask("r", learn)).alias("rejected_mask"),
    )
