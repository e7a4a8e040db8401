"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

A turn is written ``<s>[INST] role [/INST]text</s>``. Wherever a control string stands in a role or text, one backslash is
put after its first character (more than one where backslashes are there already), so that no text can end a turn, and
taking one away restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, STOP = "<s>[INST] ", " [/INST]", "</s>"
_CONTROL = r"/?s>|/?INST\]"


def escape(col: Column) -> Column:
    return F.regexp_replace(col, rf"([<\[])(\\*)({_CONTROL})", r"$1\\$2$3")


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, rf"([<\[])\\(\\*)({_CONTROL})", "$1$2$3")


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(CLOSE), escape(text), F.lit(STOP))


def prefix_target_examples(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant",
) -> DataFrame:
    """One example for every assistant turn: ``conv_id, row, example, turns, text, loss_start, loss_length, trained``.

    ``text`` has all turns up to and with the target, formatted; ``loss_start`` (from 0) and ``loss_length`` mark, in code
    points, the target's own text, the only part that is trained on. What stands after a conversation's last assistant turn
    would be in no example, so it closes the conversation as one more example without loss (start and length 0).

    Turns are ordered by turn (nulls last), then role and text; repeated rows are turns of their own. A null role or text is
    empty. A row without a conversation id is a conversation of its own, told apart by ``row`` (null for all others), so any
    number of them is spread over tasks. A conversation has to fit one string, since its examples are strings. Other columns
    are not read; an empty table gives no rows.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    alone = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id())
    rows = df.select(F.col(conv_col).alias("conv_id"), alone.alias("row"), F.col(turn_col).alias("_t"), role.alias("_role"), text.alias("_text"))
    turn = F.struct(
        F.col("_t").isNull().alias("n"), F.col("_t").alias("t"), F.col("_role").alias("role"), F.col("_text").alias("raw"),
        format_turn(F.col("_role"), F.col("_text")).alias("f"),
    )
    convs = rows.groupBy("conv_id", "row").agg(F.array_sort(F.collect_list(turn)).alias("ts"))
    convs = convs.withColumn("whole", F.array_join(F.transform("ts", lambda t: t["f"]), ""))
    convs = convs.withColumn("ends", F.aggregate("ts", F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + F.length(t["f"])))))
    last = F.size("ts") - 1
    numbered = F.transform(
        "ts", lambda t, i: F.struct(i.alias("i"), (t["role"] == target_role).alias("target"), F.length(escape(t["raw"])).alias("n")),
    )
    wanted = F.filter(numbered, lambda x: x["target"] | (x["i"] == last))
    each = convs.select("conv_id", "row", "whole", "ends", F.posexplode(wanted).alias("example", "x"))
    end = F.element_at("ends", F.col("x.i") + 2)
    start = end - len(STOP) - F.col("x.n")
    return each.select(
        "conv_id", "row", "example", (F.col("x.i") + 1).alias("turns"), F.substring("whole", F.lit(1), end).alias("text"),
        F.when(F.col("x.target"), start).otherwise(0).alias("loss_start"), F.when(F.col("x.target"), F.col("x.n")).otherwise(0).alias("loss_length"), F.col("x.target").alias("trained"),
    )


def read_turns(text: Column) -> Column:
    """The turns of an example, as ``role`` and ``text``: the template read back."""
    parts = F.filter(F.split(text, STOP, -1), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(
        unescape(x.substr(F.lit(len(OPEN) + 1), F.instr(x, F.lit(CLOSE)) - len(OPEN) - 1)).alias("role"),
        unescape(x.substr(F.instr(x, F.lit(CLOSE)) + len(CLOSE), F.length(x))).alias("text"),
    ))


def digest_examples(examples: DataFrame) -> DataFrame:
    """What the examples say, read back from their texts and masks, for each conversation.

    The grouping is by the columns that the examples are dealt out by already, so nothing is shuffled again. Each conversation
    without an id comes out as a row of its own, with a null id.
    """
    target = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_length")))
    found = examples.select("conv_id", "row", "example", "turns", "text", F.length("text").alias("chars"), F.when(F.col("trained"), target).alias("target"))
    by = found.groupBy("conv_id", "row").agg(
        F.max_by("text", "turns").alias("text"), F.array_sort(F.collect_list(F.struct("example", "target"))).alias("targets"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    turns = by.withColumn("ts", read_turns(F.col("text"))).withColumn("loss", F.array_join(F.transform("targets", lambda x: x["target"]), ""))
    said = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("ts").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


#: Lengths of what the template adds to a turn, besides escapes.
_ADDED = len(OPEN) + len(CLOSE) + len(STOP)
ORACLE_SQL = rf"""
with t as (
  select conv_id, case when conv_id is null then row_number() over () end as alone, turn, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations
  union all select -7, null, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, null, 1, 'assistant', '</s>[INST] ok [/INST]'),
f as (
  select *, {_ADDED} + length(regexp_replace(role, '([<\[])(\\*)({_CONTROL})', '\1\\\2\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)({_CONTROL})', '\1\\\2\3', 'g')) as chars from t),
p as (
  select *, sum(chars) over (partition by conv_id, alone order by turn, role, text rows unbounded preceding) as prefix,
    row_number() over (partition by conv_id, alone order by turn desc, role desc, text desc) = 1 as is_last from f)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  (sum(prefix) filter (where role = 'assistant' or is_last))::bigint as formatted_chars
from p group by conv_id, alone
"""
