"""Chat template with reversible escapes and a loss mask, in DataFrame functions only.

A conversation becomes ``<|start|>role<|text|>...<|next|>...<|end|>``: adjacent
turns of one role share a block, and ``<|next|>`` parts their texts, so that
every turn can be read back. Control strings in roles and texts (the marks of
this template and of other common ones) get a backslash behind their opening
bracket; one that already has backslashes there gets one more, which makes the
escape reversible.

One shuffle by conversation: the turn structs are collected, sorted and folded
with ``aggregate``, which puts a turn into the block before it if the roles are
the same. A fold copies what it has so far at each step, so arrays are folded in
slices first and the slices' results then: a long
conversation costs a small multiple of its length. A conversation is one output
row, so its turns meet in one task whatever their number.

Defined cases: null text or role is empty; turns of one number are ordered by
role and text; repeated rows are repeated turns; a null turn comes first; null
conversation ids form one conversation; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polislake.functions.arrays import slices, starts
from polislake.llm.common import bind, pick

# Control strings that texts must not contain unescaped, after their opening bracket.
_CONTROL = r"(/?(?:s>|INST\]|SYS>>)|\|)"
START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def blocks(turns: Column) -> Column:
    """Sorted turns as blocks (role, texts): neighbours of one role share a block."""
    none = F.array().cast("array<struct<role:string,texts:array<string>>>")
    block = lambda role, texts: F.struct(role.alias("role"), texts.alias("texts"))

    def joined(done: Column, more: Column) -> Column:
        """Two lists of blocks in a row; blocks at their border merge if they are of one role."""
        last, first = F.element_at(done, -1), F.element_at(more, 1)
        same = (F.size(done) > 0) & (F.size(more) > 0) & (F.get(done, F.size(done) - 1)["role"] == F.get(more, F.lit(0))["role"])
        merged = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(block(last["role"], F.concat(last["texts"], first["texts"]))), F.slice(more, F.lit(2), F.size(more)))
        return F.when(same, merged).otherwise(F.concat(done, more))

    folded = F.transform(slices(turns), lambda part: F.aggregate(part, none, lambda done, t: joined(done, F.array(block(t["_role"], F.array(t["_text"]))))))
    return F.aggregate(folded, none, joined)


def format_chats(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """``(_conv, formatted, loss)``: the text, and the code-point spans (start, length) of the texts of role ``learn``."""
    rows = pick(chats, _conv=(conv_col, "bigint"), _turn=(turn_col, "bigint"), _role=(role_col, "string"), _text=(text_col, "string"))
    turn = F.struct("_turn", *[escape(F.coalesce(c, F.lit(""))).alias(c) for c in ("_role", "_text")])
    chats = rows.groupBy("_conv").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    chats = bind(chats, "blocks", blocks(F.col("turns")))
    # Every text with the length of what stands before it and after the text before.
    lead = lambda b, i, j: F.when(j > 0, len(NEXT)).otherwise(F.when(i > 0, len(END)).otherwise(0) + len(START) + F.char_length(b["role"]) + len(TEXT))
    pieces = F.flatten(F.transform("blocks", lambda b, i: F.transform(b["texts"], lambda x, j: F.struct(b["role"].alias("role"), lead(b, i, j).cast("bigint").alias("lead"), F.char_length(x).cast("bigint").alias("length")))))
    chats = bind(chats.select("_conv", "blocks", pieces.alias("pieces")), "starts", starts(F.transform("pieces", lambda p: p["lead"] + p["length"])))
    spans = F.zip_with("pieces", "starts", lambda p, at: F.struct(p["role"].alias("role"), (at + p["lead"]).alias("start"), p["length"].alias("length")))
    loss = F.transform(F.filter(spans, lambda x: x["role"] == F.lit(learn)), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    body = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit(START), b["role"], F.lit(TEXT), F.array_join(b["texts"], NEXT), F.lit(END))), "")
    return chats.select("_conv", body.alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns of each formatted conversation as ``turns``: array of (role, text)."""
    blocks = F.split(F.substring("formatted", len(START) + 1, 2**31 - 1), r"<\|end\|>(?:<\|start\|>)?", -1)
    blocks = F.filter(blocks, lambda b: F.contains(b, F.lit(TEXT)))

    def turns(block: Column) -> Column:
        parts = F.split(block, r"<\|text\|>", 2)
        return F.transform(F.split(parts[1], r"<\|next\|>", -1), lambda x: F.struct(unescape(parts[0]).alias("role"), unescape(x).alias("text")))

    return formatted.withColumn("turns", F.flatten(F.transform(blocks, turns)))


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


_ESC = r"regexp_replace({}, '([<\[])(\\*)(/?(?:s>|INST\]|SYS>>)|\|)', '\1\\\2\3', 'g')"
ORACLE = f"""
with c as (select conv_id, turn, role, text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from c),
e as (select *, lag(role) over w is not distinct from role as same from r window w as (partition by conv_id order by turn, role, text))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length({_ESC.format("text")}) + case when same then {len(NEXT)} else {len(START + TEXT + END)} + length({_ESC.format("role")}) end)::bigint as formatted_chars
from e group by conv_id
"""
