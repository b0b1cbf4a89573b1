"""Text search by subwords: questions meet texts on stems and character trigrams, so that ``ages`` meets ``age``.

The similarity of a question and a text is the share of the question's weight that the text holds, from 0 to 1. Each
word of the question weighs 1, half for its stem and half over the trigrams of ``^stem$``, times how rare each is
among the texts. Search is exact and pairs nothing but what can reach the threshold: the parts of a question are ordered
from rare to common, and a text that shares none of the first ones, up to where the rest weighs less than the threshold, can't
reach it. Only these first parts are looked up in the postings, so common ones are not joined unless a question holds
nothing else; then their postings are dealt over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.expressions import small
from plumbline.operators.similarity import terms
from plumbline.operators.skew import SALTS, hot_keys

SMALL = 1e-9
STEMS = [("^(.{2,})ies$", "$1y"), ("^(.{2,}(?:ss|x|ch|sh))es$", "$1"), ("^(.{2,}[^su])s$", "$1"), ("^(.{3,})ing$", "$1"), ("^(.{3,}[^e])ed$", "$1")]


def stem(term: Column) -> Column:
    """An English word without its plural or verb ending, by the first rule that fits."""
    out = term
    for pattern, to in reversed(STEMS):
        out = F.when(term.rlike(pattern), F.regexp_replace(term, pattern, to)).otherwise(out)
    return out


def parts(text: Column) -> Column:
    """array<struct<part, share>>: stems and trigrams of the words of a text; the shares of a word add up to 1."""
    def of(word: Column) -> Column:
        framed = F.concat(F.lit("^"), word, F.lit("$"))
        n = F.char_length(word)
        grams = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substr(framed, i, F.lit(3)).alias("part"), (F.lit(0.5) / n).alias("share")))
        return F.concat(F.array(F.struct(F.concat(F.lit("="), word).alias("part"), F.lit(0.5).cast("double").alias("share"))), grams)

    return F.flatten(F.transform(F.transform(terms(text), stem), of))


def _exploded(rows: DataFrame, ident: str, text: str, name: str) -> DataFrame:
    """(name, part, share): the parts of each text, their shares added up."""
    each = rows.select(F.col(ident).alias(name), F.explode(parts(F.col(text))).alias("p"))
    return each.groupBy(name, F.xxhash64("p.part").alias("part")).agg(F.sum("p.share").alias("share"))


def subword_top_k(queries: DataFrame, corpus: DataFrame, query_id: str, query_text: str, item_id: str, item_text: str, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """(query_id, item_id, similarity, place): the ``k`` texts that hold most of each question, at least ``threshold`` of it.

    Ties go to the smaller item_id. Null and empty texts and questions match nothing.
    """
    held = _exploded(corpus, item_id, item_text, "d").select("d", "part")
    size = corpus.agg(F.count(F.lit(1)).alias("n")).scalar()
    frequency = held.groupBy("part").agg(F.count(F.lit(1)).alias("df"))
    asked = _exploded(queries, query_id, query_text, "q").join(frequency, "part", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    whole, rarest = W.partitionBy("q"), W.partitionBy("q").orderBy("df", "part")
    weighed = asked.withColumn("w", F.col("share") * (F.log((1.0 + size) / (1.0 + F.col("df"))) + 1.0)).withColumn("whole", F.sum("w").over(whole))
    known = weighed.where("df > 0")
    left = F.sum("w").over(rarest.rowsBetween(W.currentRow, W.unboundedFollowing))
    first = known.withColumn("left", left).where(F.col("left") >= F.col("whole") * threshold - SMALL)

    hot = hot_keys(frequency, ["part"], "df")
    salted = first.join(small(hot), "part", "left").select("q", "part", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    postings = held.join(small(hot), "part", "left").select("d", "part", F.when(F.col("_hot"), F.pmod(F.xxhash64("d"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"))
    pairs = salted.join(postings, ["part", "salt"]).select("q", "d").distinct()

    matched = pairs.join(known.select("q", "part", "w", "whole"), "q").join(held, ["d", "part"])
    scored = matched.groupBy("q", "d").agg((F.sum("w") / F.first("whole")).alias("similarity")).where(F.col("similarity") >= threshold - SMALL)
    best = W.partitionBy("q").orderBy(F.desc(F.round("similarity", 12)), F.asc("d"))
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select(F.col("q").alias(query_id), F.col("d").alias(item_id), "similarity", "place")
