"""Chat formatting: collapse cumulative snapshots of conversations, then render those that are left.

Logs often hold a conversation again after every reply. Each conversation becomes its turns in order; a rolling hash
covers each prefix of turns. A conversation whose whole hash is a proper prefix hash of another one is a snapshot: an
anti-join drops it. Equal conversations are one, under the smallest id. Built-in functions only.

Hashes are chained SHA-256 over length-prefixed roles and texts, so prefixes are equal exactly when the turns are. A
prefix hash leaves a conversation once, and both sides of the joins are distinct hashes: a first turn or a whole
conversation that is very common is summed up before any shuffle by hash.

Defined cases: a null role or text counts as ''; a turn repeated with the same number, role and text counts once; turns
with one number and different contents go by role, then text; a null turn number comes first; rows without a
conversation id are of no conversation and are left out; an empty table gives an empty one. Only the four columns are
read, so names of other columns don't clash. A conversation's turns meet in one row, as its rendered text does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barfold.llm.shared import written


def conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id and its turns (turn, role, text), in order."""
    said = F.struct(
        F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    rows = df.filter(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").alias("conv_id"), said.alias("said"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_set("said")).alias("turns"))


def prefix_hashes(turns: Column) -> Column:
    """Hash of the first turn, of the first two, and so on."""
    start = F.array().cast("array<string>")

    def step(done: Column, t: Column) -> Column:
        before = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))
        return F.concat(done, F.array(F.sha2(F.concat(before, F.octet_length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]).cast("binary"), 256)))

    return F.aggregate(turns, start, step)


def render(turns: Column) -> Column:
    """Each turn between markers, the way chat models read it."""
    one = F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n")))
    return F.array_join(one, "")


def collapse(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Maximal conversations: conv_id (the smallest of equal ones), n_turns, n_equal and the rendered text."""
    told = written(conversations(df, conv, turn, role, text).withColumn("hashes", prefix_hashes(F.col("turns"))))
    whole = told.select("conv_id", F.element_at("hashes", -1).alias("whole"))
    classes = whole.groupBy("whole").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    proper = told.filter(F.size("hashes") > 1).select(F.explode(F.slice("hashes", F.lit(1), F.size("hashes") - 1)).alias("whole")).distinct()
    longest = classes.join(proper, "whole", "left_anti")
    return told.join(longest.select("conv_id", "n_equal"), "conv_id").select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_equal", render(F.col("turns")).alias("rendered"))
