"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered with that speaker as the assistant and all others
as named users; loss is borne by the assistant's words and the mark that ends them. The result has one row per message and perspective:
its rendered piece and where it lies in the rendered dialogue, so that a conversation of any length is never gathered in one place.
Offsets are prefix sums in two steps: within blocks of BLOCK turns, and over the totals of the blocks. A block with more than HOT messages (turns that are
null, or one turn with very many) is cut further by turn, speaker and leading digits of the text's hash, by which messages of one speaker and
turn are ordered. Conversations with more than HOT messages are salted where messages meet speakers; the tables of such blocks and
conversations have at most one row for HOT messages, so they are broadcast. Equal messages of one turn and speaker beyond that stay together.

Defined results: messages are ordered by turn (null turns last), role, MD5 of the text and text, equal rows being interchangeable; a null
role is the speaker "unknown"; null text is empty; role "system" is nobody's perspective and is rendered as system in all; so a conversation of
system messages alone has no rows; rows with a null conv_id form one conversation; marks of the format inside texts are broken by a
space; an empty table gives an empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The marks of the chat format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
BLOCK = 256
#: Messages of a conversation, or of a block, from which on it is spread over several tasks.
HOT = 1 << 20


def rotate(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation, perspective and message."""
    m = messages.select(
        F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("unknown")).alias("speaker"),
        F.replace(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"),
    )
    m = m.withColumn("h", F.md5("body")).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(2**62)))
    counts = m.groupBy("conv_id", "block", "speaker").agg(F.count("*").alias("n"))
    many = counts.groupBy(F.col("conv_id").alias("_conv")).agg(F.sum("n").alias("_n")).where(F.col("_n") > HOT).select("_conv", F.ceil(F.col("_n") / HOT).alias("_salts"))
    full = counts.groupBy(F.col("conv_id").alias("_conv"), F.col("block").alias("_block")).agg(F.sum("n").alias("_n")).where(F.col("_n") > HOT)
    full = full.select("_conv", "_block", F.ceil(F.log2(16 * F.col("_n") / HOT) / 4).cast("int").alias("_digits"))
    in_conv = F.col("conv_id").eqNullSafe(F.col("_conv"))
    m = m.join(F.broadcast(full), in_conv & (F.col("block") == F.col("_block")), "left").drop("_conv", "_block")
    cut = F.struct(F.coalesce("turn", F.lit(2**63 - 1)).alias("turn"), "speaker", F.expr("substring(h, 1, _digits)").alias("h"))
    m = m.withColumn("sub", F.when(F.col("_digits").isNotNull(), cut)).drop("_digits")
    m = m.join(F.broadcast(many), in_conv, "left").drop("_conv").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("turn", "speaker", "body"), "_salts"), F.lit(0))).drop("_salts")
    who = counts.where(F.col("speaker") != "system").select("conv_id", F.col("speaker").alias("perspective")).distinct().join(F.broadcast(many), in_conv, "left")
    who = who.select(F.col("conv_id").alias("_conv"), "perspective", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1)).alias("_salt"))
    x = m.join(who, in_conv & (F.col("salt") == F.col("_salt"))).drop("_conv", "_salt", "salt")
    own = F.col("speaker") == F.col("perspective")
    name = F.replace(F.col("speaker"), F.lit("<|"), F.lit("< |"))
    head = F.when(own, F.lit(f"{OPEN}assistant\n")).when(F.col("speaker") == "system", F.lit(f"{OPEN}system\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), name, F.lit("\n")))
    x = x.select(
        "conv_id", "perspective", "turn", "speaker", "body", "h", "block", "sub",
        F.when(own, F.lit("assistant")).when(F.col("speaker") == "system", F.lit("system")).otherwise(F.lit("user")).alias("role"),
        head.alias("head"), own.alias("loss"),
    )
    x = x.withColumn("rendered", F.concat("head", "body", F.lit(f"{CLOSE}\n"))).withColumn("n", F.length("rendered").cast("long"))
    before = Window.partitionBy("conv_id", "perspective", "block", "sub").orderBy(F.col("turn").asc_nulls_last(), "speaker", "h", "body").rowsBetween(Window.unboundedPreceding, -1)
    inside = x.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("k", F.count("n").over(before))
    earlier = Window.partitionBy("_conv", "_perspective").orderBy("_block", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    totals = x.groupBy(F.col("conv_id").alias("_conv"), F.col("perspective").alias("_perspective"), F.col("block").alias("_block"), F.col("sub").alias("_sub")).agg(F.sum("n").alias("_n"), F.count("*").alias("_k"))
    totals = totals.select("_conv", "_perspective", "_block", "_sub", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_at"), F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("perspective") == F.col("_perspective")) & (F.col("block") == F.col("_block")) & F.col("sub").eqNullSafe(F.col("_sub"))
    start = F.col("at") + F.col("_at")
    return inside.join(totals, same).select(
        "conv_id", "perspective", (F.col("k") + F.col("_before")).cast("long").alias("position"), "turn", "speaker", "role", "rendered",
        start.cast("long").alias("start"), (start + F.col("n")).cast("long").alias("end"), "loss",
        F.when(F.col("loss"), start + F.length("head")).cast("long").alias("loss_start"),
        F.when(F.col("loss"), start + F.col("n") - 1).cast("long").alias("loss_end"),
    )


SQL = f"""
with m as (select conv_id, turn, coalesce(role, 'unknown') as speaker, replace(coalesce(text, ''), '<|', '< |') as body from conversations),
who as (select distinct conv_id as c, speaker as perspective from m where speaker <> 'system'),
x as (select conv_id, perspective, turn, speaker, body, speaker = perspective as loss,
        case when speaker = perspective then 'assistant' when speaker = 'system' then 'system' else 'user' end as role,
        case when speaker = perspective then '{OPEN}assistant' || chr(10) when speaker = 'system' then '{OPEN}system' || chr(10)
             else '{OPEN}user name=' || replace(speaker, '<|', '< |') || chr(10) end as head
      from m join who on conv_id is not distinct from c),
r as (select *, head || body || '{CLOSE}' || chr(10) as rendered, length(head || body || '{CLOSE}' || chr(10)) as n from x),
s as (select *, row_number() over w - 1 as position, sum(n) over w - n as start from r
      window w as (partition by conv_id, perspective order by turn asc nulls last, speaker, md5(body), body rows between unbounded preceding and current row))
select conv_id, perspective, position::bigint as position, turn, speaker, role, rendered, start::bigint as start, (start + n)::bigint as "end", loss,
       (case when loss then start + length(head) end)::bigint as loss_start, (case when loss then start + n - 1 end)::bigint as loss_end
from s
"""
