"""Preference formatting: one prompt for what two conversations share, and a masked completion for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import let

OPEN, SHUT, END = "<|", "|>\n", "\n<|end|>\n"
LEARNT = "assistant"


def _whole(turns: DataFrame, name: str) -> DataFrame:
    """One row for each pair_id, null left out: its turns in order. A conversation is one row, as long as it is."""
    return turns.where("pair_id is not null").groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias(name))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(SHUT))


def _body(turn: Column) -> Column:
    return F.coalesce(turn["text"], F.lit(""))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """[start, end) in code points of the rendered turns that are learnt: what the assistant said, with its end mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        first = s["at"] + F.char_length(_head(t))
        last = first + F.char_length(_body(t)) + len(END)
        said = F.when(t["role"] == LEARNT, F.array(F.struct(first.cast("int").alias("start"), last.cast("int").alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct(last.cast("int").alias("at"), F.concat(s["spans"], said).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pairs of conversations (pair_id, turn, role, text) as prompt, chosen and rejected, with masks for the loss.

    (pair_id, n_shared, prompt, chosen, chosen_mask, rejected, rejected_mask, usable): prompt renders the longest
    common prefix of turns (equal role and text, null equal to null) once, chosen and rejected what follows it, and the
    masks are the learnt spans of those. Turns go by turn, then role and text; a null role or text renders as empty.
    A pair_id of one side only is left out, and so is a null one. Two equal conversations share all and are not usable; neither is a
    pair of which a side has nothing to learn. Empty tables give an empty table.
    """
    both = _whole(chosen, "c").join(_whole(rejected, "r"), "pair_id")
    same = F.zip_with("c", "r", lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    shared = let(F.array_position(same, False), lambda at: F.when(at > 0, at - 1).otherwise(F.size(same))).cast("int")
    cut = both.withColumn("n_shared", shared)
    rest = lambda side: F.slice(side, F.col("n_shared") + 1, F.greatest(F.size(side), F.lit(1)))
    cut = cut.select("pair_id", "n_shared", F.slice("c", F.lit(1), "n_shared").alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    made = cut.select("pair_id", "n_shared", _rendered(F.col("p")).alias("prompt"), _rendered(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"), _rendered(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"))
    return made.withColumn("usable", (F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
