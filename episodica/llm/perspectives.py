"""Chat formatting (2): multi-party perspective rotation.

Every participant of a dialogue (its roles but system ones) is the assistant once: the dialogue is rendered with that
speaker's turns as assistant turns, the other speakers' as turns of named users, and system turns as they are.  A segment is one turn of
one perspective, with its place in the rendered dialogue and its mask: 1 for what the model is to learn (the speaker's own words and
the end mark), 0 for all else.  A dialogue's text is its segments in order of ``start``; write_dialogues() puts them together in
parts of bounded size.

All turns are dealt into ranges of their order (dialogue, turn, role, text, and a number that tells equal rows apart), so a block, the
turns of a dialogue in one range, is bounded whatever the dialogue, and however many turns share a number or have none.  (Ranges are
drawn by the first PREFIX characters of a text: longer texts that share turn, role and these stay in one block.)  Speakers meet
turns by block, and places are running sums, taken within blocks and then over the sums of blocks: no task needs a whole dialogue.

Defined results: turns are in order of turn, role, text, nulls first; a null text is empty, a null or blank role is "unknown";
rows with a null conv_id are one dialogue; repeated rows are turns of their own; a dialogue of system turns only has no participant and no
rows; extra columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared

#: Turns in a part of a written dialogue; characters of a text that the ranges go by.
PART, PREFIX = 256, 1024
SYSTEM, UNKNOWN = "system", "unknown"
END = "<|end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    role = F.trim(F.col("role").cast("string"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.col("turn").cast("long")
    conv_id = F.col("conv_id").cast("long")
    # conv names the dialogue where keys must be equal: null is one, too
    conv = F.coalesce(conv_id.cast("string"), F.lit("none")).alias("conv")
    rows = conversations.select(conv_id.alias("conv_id"), conv, turn.alias("turn"), F.when(role.isNull() | (role == ""), UNKNOWN).otherwise(role).alias("role"), text.alias("text"))
    size = F.least(F.length("text"), F.lit(PREFIX + 1))
    tie = F.when(size <= PREFIX, F.monotonically_increasing_id()).otherwise(0)
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("tie", tie).repartitionByRange(ranges, "conv_id", "turn", "role", F.substring("text", 1, PREFIX), size, "tie")
    return shared(rows.drop("tie").withColumn("block", F.spark_partition_id()))


def header(role: Column, speaker: Column) -> Column:
    said = F.when(role == SYSTEM, "system").when(role == speaker, "assistant").otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit("<|"), said, F.lit("|>\n"))


def segments(conversations: DataFrame) -> DataFrame:
    """conv_id, speaker, position, turn, role, segment, start, learn_from, end, mask: a row per participant and turn.

    Code points, ends exclusive; where mask is 1 the model learns from learn_from to end.
    """
    turns = _turns(conversations)
    roles = turns.select("conv", "block", "role").distinct()  # rows meet before the shuffle
    speakers = roles.where(F.col("role") != SYSTEM).select("conv", F.col("role").alias("speaker")).distinct()
    here = roles.select("conv", "block").distinct().join(speakers, "conv")
    rows = turns.join(here, ["conv", "block"])
    rows = rows.withColumn("head", header(F.col("role"), F.col("speaker"))).withColumn("segment", F.concat("head", "text", F.lit(END)))
    key = ["conv", "block", "speaker"]
    order = Window.partitionBy(*key).orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = rows.withColumn("nth", F.row_number().over(order).cast("long")).withColumn("upto", F.sum(F.length("segment")).over(upto).cast("long"))
    blocks = rows.groupBy(*key).agg(F.sum(F.length("segment")).cast("long").alias("length"), F.count("*").alias("turns"))
    before = Window.partitionBy("conv", "speaker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    out = inner.join(blocks.select(*key, F.coalesce(F.sum("length").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("passed")), key)
    end = F.col("base") + F.col("upto")
    start = end - F.length("segment")
    return out.select("conv_id", "speaker", (F.col("passed") + F.col("nth") - 1).alias("position"), "turn", "role", "segment", start.alias("start"), (start + F.length("head")).alias("learn_from"), end.alias("end"), (F.col("role") == F.col("speaker")).cast("int").alias("mask"))


def dialogues(conversations: DataFrame, turns: int = PART) -> DataFrame:
    """conv_id, speaker, part, text, spans: each perspective's text in parts of at most ``turns`` turns, with the spans (from, to) to learn, in the part's own places."""
    rows = segments(conversations).withColumn("part", F.floor(F.col("position") / turns))
    parts = rows.groupBy("conv_id", "speaker", "part").agg(F.array_sort(F.collect_list(F.struct("position", "segment", "start", "learn_from", "end", "mask"))).alias("x"))
    first = F.col("x")[0]["start"]
    spans = F.transform(F.filter("x", lambda s: s["mask"] == 1), lambda s: F.struct((s["learn_from"] - first).alias("from"), (s["end"] - first).alias("to")))
    return parts.select("conv_id", "speaker", "part", F.array_join(F.transform("x", lambda s: s["segment"]), "").alias("text"), spans.alias("spans"))


def write_dialogues(conversations: DataFrame, path: str) -> None:
    shared(dialogues(conversations)).write.json(path)
