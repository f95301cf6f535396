"""Preference pairs as one prompt and two masked completions.

Only DataFrame functions: no Python runs in tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks around a turn: start, role, line feed, text, end, line feed.
START, END = "<|im_start|>", "<|im_end|>"
#: Turns whose text and end mark are trained on.
TRAINED = "assistant"
#: Role of turns that name none.
ROLE = "user"


def conversations(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> ``conv_id, turns``: the turns in
    order, ties by role and text."""
    return (turns.where("conv_id is not null")
            .groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit(ROLE)).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns")))


def consecutive_pairs(turns: DataFrame) -> DataFrame:
    """``pair_id, chosen, rejected``: conversation 2n chosen, 2n + 1 rejected;
    one without its partner stands alone."""
    side = F.pmod("conv_id", F.lit(2))
    ids = turns.where("conv_id is not null").select("conv_id").distinct()
    return (ids.groupBy(F.floor(F.col("conv_id") / 2).alias("pair_id"))
            .agg(F.max(F.when(side == 0, F.col("conv_id"))).alias("chosen"), F.max(F.when(side == 1, F.col("conv_id"))).alias("rejected")))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")


def _spans(turns: Column) -> Column:
    """(start, end) in characters of what is trained on in a completion."""
    def step(state: Column, t: Column) -> Column:
        head = state["at"] + len(START) + F.length(t["role"]) + 1
        tail = head + F.length(t["text"]) + len(END)
        spans = F.when(t["role"] == TRAINED, F.concat(state["spans"], F.array(F.struct(head.alias("start"), tail.alias("end"))))).otherwise(state["spans"])
        return F.struct((tail + 1).alias("at"), spans.alias("spans"))

    nothing = F.struct(F.lit(0).alias("at"), F.slice(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), 1, 0).alias("spans"))
    return F.aggregate(turns, nothing, step, lambda state: state["spans"])


def preference_examples(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text, ...)`` and ``pairs(pair_id, chosen,
    rejected)`` -> ``pair_id, n_prompt_turns, prompt, chosen, chosen_spans,
    rejected, rejected_spans``.

    The longest common prefix of turns, equal in role and text, is rendered
    once as the prompt, what follows it as the two completions. Loss counts on
    the spans of a completion alone: text and end mark of assistant turns.
    Equal conversations are all prompt; a pair with a missing side has an
    empty one and no prompt. A null role is ``user``, a null text empty, a
    null turn comes first; equal turn numbers go by role and text, repeated
    rows are turns of their own. Turns without conv_id belong to no pair; empty
    tables give no rows; other columns are not read. A conversation is one row
    of the result, so it has to fit in one."""
    own = conversations(turns)

    def side(name: str) -> DataFrame:
        return own.select(F.col("conv_id").alias(name), F.col("turns").alias(f"{name}_turns"))

    none = F.expr("cast(array() as array<struct<turn:bigint,role:string,text:string>>)")
    both = (pairs.select("pair_id", "chosen", "rejected").join(side("chosen"), "chosen", "left").join(side("rejected"), "rejected", "left")
            .select("pair_id", *(F.coalesce(f"{s}_turns", none).alias(s) for s in ("chosen", "rejected"))))
    same = F.zip_with("chosen", "rejected", lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    both = both.withColumn("same", same).withColumn("n", F.when(F.array_position("same", F.lit(False)) > 0, F.array_position("same", F.lit(False)) - 1).otherwise(F.size("same")).cast("int"))
    for s in ("chosen", "rejected"):
        both = both.withColumn(f"{s}_left", F.expr(f"slice({s}, n + 1, size({s}) + 1)"))
    return both.select("pair_id", F.col("n").cast("long").alias("n_prompt_turns"), _render(F.expr("slice(chosen, 1, n)")).alias("prompt"),
                       _render(F.col("chosen_left")).alias("chosen"), _spans(F.col("chosen_left")).alias("chosen_spans"),
                       _render(F.col("rejected_left")).alias("rejected"), _spans(F.col("rejected_left")).alias("rejected_spans"))


def spans_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


#: The result of the query for consecutive conversations, in DuckDB SQL.
SQL = f"""
with t as (
  select conv_id, conv_id // 2 as pair_id, conv_id % 2 as side, coalesce(role, '{ROLE}') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, '{ROLE}'), coalesce(text, '')) - 1 as pos
  from conversations where conv_id is not null),
m as (
  select coalesce(a.pair_id, b.pair_id) as pair_id, coalesce(a.pos, b.pos) as pos,
    a.role is not distinct from b.role and a.text is not distinct from b.text as same
  from (select * from t where side = 0) a full join (select * from t where side = 1) b on a.pair_id = b.pair_id and a.pos = b.pos),
l as (select pair_id, coalesce(min(pos) filter (where not same), max(pos) + 1) as n from m group by pair_id),
r as (select t.*, n, '{START}' || role || chr(10) || text || '{END}' || chr(10) as s from t join l using (pair_id)),
o as (
  select *, sum(length(s)) over (partition by pair_id, side, pos >= n order by pos) - length(s) + {len(START)} + length(role) + 1 as head
  from r)
select pair_id, max(n) as n_prompt_turns,
  coalesce(string_agg(s, '' order by pos) filter (where side = 0 and pos < n), '') as prompt,
  coalesce(string_agg(s, '' order by pos) filter (where side = 0 and pos >= n), '') as chosen,
  coalesce(string_agg((head)::bigint || ':' || (head + length(text) + {len(END)})::bigint, ',' order by pos) filter (where side = 0 and pos >= n and role = '{TRAINED}'), '') as chosen_spans,
  coalesce(string_agg(s, '' order by pos) filter (where side = 1 and pos >= n), '') as rejected,
  coalesce(string_agg((head)::bigint || ':' || (head + length(text) + {len(END)})::bigint, ',' order by pos) filter (where side = 1 and pos >= n and role = '{TRAINED}'), '') as rejected_spans
from o group by pair_id
"""
