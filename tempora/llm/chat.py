"""Chat formatting: a dialogue rendered once for every participant, who is the assistant there.

DataFrame functions only.  Other speakers are users named by their role; system
turns are context in every rendering.  The mask is the list of character spans
that the perspective's own turns cover (text and end mark).

A rendering is given in parts of PART turns, so that the rows that meet in one
group are bounded however long one conversation grows: the parts of a
perspective, one after the other, are the whole rendering, and `start` says
where a part begins in it.  Turns get their places from sorted ranges of the
whole table, so no task sorts a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

#: Turns of a part.
PART = 1024
#: The role that is context and takes no part.
SYSTEM = "system"
END = "<|end|>\n"
#: What opens a mark, and how it is written in texts and names, which so can't forge one.
MARK, ESCAPED = "<|", "<\\|"


def _placed(conversations: DataFrame, conv: str, turn: str, role: str, text: str, part: int) -> DataFrame:
    """Turns with the part of their conversation that they fall into."""
    plain = lambda c, null: F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null)), F.lit(MARK), F.lit(ESCAPED))
    turns = conversations.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), plain(role, "unknown").alias("role"), plain(text, "").alias("text"))
    order = ["turn", "role", "text"]
    ranges = written(turns.repartitionByRange("conv", *order).withColumn("range", F.spark_partition_id()))
    # a row for each conversation and range
    sizes = ranges.groupBy("conv", "range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("conv").alias("of"), F.col("range").alias("at"), (F.sum("n").over(Window.partitionBy("conv").orderBy("range")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("conv", "range").orderBy(*order)).alias("own")
    both = ranges.select("*", own).join(before, F.col("conv").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
    return both.select("conv", F.floor((F.col("before") + F.col("own") - 1) / part).cast("long").alias("part"), *order)


def perspectives(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part: int = PART) -> DataFrame:
    """(conv, part, perspective, n_turns, n_targets, start, rendered, spans): a row for each part and participant of its conversation.

    rendered: the part's turns; start: characters of the parts before; spans:
    the perspective's own turns, counted from the part's start.  A null role is
    'unknown', a null text is empty, a null turn comes first.  Turns of one
    number go by role, then text; repeated rows are turns of their own.  A null
    conv is a conversation of its own.  A conversation of system turns alone
    has no participant and no row.  MARK is escaped in texts and roles.  Other
    columns are left to the caller.
    """
    turns = _placed(conversations, conv, turn, role, text, part)
    parts = turns.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = turns.where(F.col("role") != SYSTEM).select(F.col("conv").alias("of"), F.col("role").alias("perspective")).distinct()
    both = parts.join(speakers, F.col("conv").eqNullSafe(F.col("of")))
    shown = both.withColumn("shown", F.transform("turns", lambda t: _shown(t, F.col("perspective"))))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    rendered = shown.select(
        "conv",
        "part",
        "perspective",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["role"] == F.col("perspective"))).cast("long").alias("n_targets"),
        F.array_join(F.transform("shown", lambda s: F.concat(s["head"], s["body"])), "").alias("rendered"),
        F.aggregate("shown", first, _spans, lambda s: s["spans"]).alias("spans"),
    )
    length = F.length("rendered").cast("long")
    start = F.sum(length).over(Window.partitionBy("conv", "perspective").orderBy("part")) - length
    return rendered.select(F.col("conv").alias(conv), "part", "perspective", "n_turns", "n_targets", start.alias("start"), "rendered", "spans")


def _shown(t: Column, perspective: Column) -> Column:
    head = F.when(t["role"] == SYSTEM, F.lit("<|system|>\n")).when(t["role"] == perspective, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), t["role"], F.lit("|>\n")))
    return F.struct(head.alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), (t["role"] == perspective).alias("target"))


def _spans(state: Column, s: Column) -> Column:
    start = state["at"] + F.length(s["head"])
    end = start + F.length(s["body"])
    span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
    return F.struct(end.cast("long").alias("at"), F.when(s["target"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))
