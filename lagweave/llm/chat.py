"""Preference formatting of conversation pairs, with SQL functions only.

For a chosen and a rejected conversation the longest common prefix of turns is rendered once
as the prompt; what remains of each becomes its completion, with a mask that marks the
characters to learn from (what the assistant says, and its end mark).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rendering of a turn: header, text, end mark.
HEADER, MIDDLE, CLOSE = "<|start|>", "\\n", "<|end|>\\n"


def _render(turns: str) -> str:
    return f"array_join(transform({turns}, t -> concat('{HEADER}', coalesce(t.role, ''), '{MIDDLE}', coalesce(t.text, ''), '{CLOSE}')), '')"


def _mask(turns: str, learner: str) -> str:
    """Runs ``length:flag`` in characters: header 0, text and end mark 1 for the learner's turns, all 0 for the others."""
    head = f"char_length(concat('{HEADER}', coalesce(t.role, ''), '{MIDDLE}'))"
    body = f"char_length(concat(coalesce(t.text, ''), '{CLOSE}'))"
    return f"array_join(transform({turns}, t -> if(t.role <=> '{learner}', concat({head}, ':0,', {body}, ':1'), concat({head} + {body}, ':0'))), ',')"


def preference_pairs(turns: DataFrame, pairs: DataFrame | None = None, learner: str = "assistant") -> DataFrame:
    """Rows (pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask).

    turns: conv_id, turn, role, text.  pairs: pair_id, chosen, rejected (conversation ids); without
    it, conversations 2p and 2p + 1 are the chosen and the rejected one of pair p.  Turns go by
    (turn, role, text); a null role or text is rendered empty, and equals only null.  A pair of which one
    side is missing has no common turn, and that side's completion is empty; one of which both are missing gives no row.  Repeated rows are turns
    of their own.  Rows with a null conv_id belong to no conversation.
    """
    t = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"))
    if pairs is None:
        t = t.select(F.expr("conv_id div 2 - if(conv_id % 2 < 0, 1, 0)").alias("pair_id"), F.expr("pmod(conv_id, 2)").alias("side"), "t")
    else:
        sides = pairs.select("pair_id", F.posexplode(F.array(F.col("chosen").cast("long"), F.col("rejected").cast("long"))).alias("side", "conv_id"))
        t = sides.join(t, "conv_id").select("pair_id", "side", "t")
    sides = [F.array_sort(F.collect_list(F.when(F.col("side") == k, F.col("t")))).alias(name) for k, name in ((0, "c"), (1, "r"))]
    both = t.groupBy("pair_id").agg(*sides)
    differs = "array_position(zip_with(slice(c, 1, least(size(c), size(r))), slice(r, 1, least(size(c), size(r))), (a, b) -> a.role <=> b.role and a.text <=> b.text), false)"
    both = both.withColumn("n_common", F.expr(f"cast(if({differs} > 0, {differs} - 1, least(size(c), size(r))) as int)"))
    both = both.select("pair_id", "n_common", F.expr("slice(c, 1, n_common)").alias("p"), F.expr("slice(c, n_common + 1, size(c))").alias("c"), F.expr("slice(r, n_common + 1, size(r))").alias("r"))
    return both.select(
        "pair_id",
        "n_common",
        F.expr(_render("p")).alias("prompt"),
        F.expr(_render("c")).alias("chosen"),
        F.expr(_render("r")).alias("rejected"),
        F.expr(_mask("c", learner)).alias("chosen_mask"),
        F.expr(_mask("r", learner)).alias("rejected_mask"),
    )


ORACLE = """
with t as (
  select cast(floor(conv_id / 2.0) as bigint) pair_id, conv_id - 2 * cast(floor(conv_id / 2.0) as bigint) side, role, text,
         row_number() over (partition by conv_id order by turn, role, text) k
  from conversations where conv_id is not null),
m as (
  select a.pair_id, a.k from t a join t b on a.pair_id = b.pair_id and a.k = b.k and a.side = 0 and b.side = 1
  where a.role is not distinct from b.role and a.text is not distinct from b.text),
run as (select pair_id, k, row_number() over (partition by pair_id order by k) n from m),
common as (select pair_id, count(*) n_common from run where k = n group by pair_id),
r as (
  select t.pair_id, side, k, coalesce(n_common, 0) n_common,
         '<|start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) body,
         case when role = 'assistant'
              then (10 + length(coalesce(role, '')))::varchar || ':0,' || (8 + length(coalesce(text, '')))::varchar || ':1'
              else (18 + length(coalesce(role, '')) + length(coalesce(text, '')))::varchar || ':0' end mask
  from t left join common on t.pair_id = common.pair_id)
select pair_id, cast(max(n_common) as integer) n_common,
       coalesce(string_agg(body, '' order by k) filter (side = 0 and k <= n_common), '') prompt,
       coalesce(string_agg(body, '' order by k) filter (side = 0 and k > n_common), '') chosen,
       coalesce(string_agg(body, '' order by k) filter (side = 1 and k > n_common), '') rejected,
       coalesce(string_agg(mask, ',' order by k) filter (side = 0 and k > n_common), '') chosen_mask,
       coalesce(string_agg(mask, ',' order by k) filter (side = 1 and k > n_common), '') rejected_mask
from r group by pair_id
"""
