"""Similarity search: sparse text vectors joined on shared terms, dense vectors by blocked products."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TERM_SPLIT = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TERM_SPLIT), lambda t: t != "")


def text_top_k(queries: DataFrame, corpus: DataFrame, query_id: str, query_text: str, item_id: str, item_text: str,
               k: int = 5, threshold: float = 0.0) -> DataFrame:
    """(query_id, item_id, similarity, place): the ``k`` nearest corpus texts per query.

    Cosine of TF-IDF vectors, document frequencies taken from the corpus. The pairs come from an
    inverted index (a join on terms), so texts that share nothing never meet. The corpus is meant to
    be a catalogue (rules, decisions, feedback): a term most of its texts share meets them all.
    """
    q = queries.select(F.col(query_id).alias("q"), F.explode(terms(F.col(query_text))).alias("term"))
    d = corpus.select(F.col(item_id).alias("d"), F.explode(terms(F.col(item_text))).alias("term"))
    q_tf = q.groupBy("q", "term").agg(F.count(F.lit(1)).alias("tf"))
    d_tf = d.groupBy("d", "term").agg(F.count(F.lit(1)).alias("tf"))
    size = corpus.agg(F.count(F.lit(1)).alias("n")).scalar()
    df = d_tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def weigh(tf: DataFrame, ident: str) -> DataFrame:
        idf = F.log((1.0 + size) / (1.0 + F.coalesce(F.col("df"), F.lit(0)))) + 1.0
        weighted = tf.join(df, "term", "left").withColumn("w", F.col("tf") * idf)
        norms = weighted.groupBy(ident).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return weighted.join(norms, ident).select(ident, "term", (F.col("w") / F.col("norm")).alias("w"))

    left = weigh(q_tf, "q").withColumnRenamed("w", "wq")
    right = weigh(d_tf, "d").withColumnRenamed("w", "wd")
    scored = left.join(right, "term").groupBy("q", "d").agg(F.sum(F.col("wq") * F.col("wd")).alias("similarity"))
    best = W.partitionBy("q").orderBy(F.desc(F.round("similarity", 12)), F.asc("d"))
    return (
        scored.where(F.col("similarity") >= threshold)
        .withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
        .select(F.col("q").alias(query_id), F.col("d").alias(item_id), "similarity", "place")
    )


QUERY_BLOCK = 2048
CORPUS_SLICE = 50_000
SLICE_BYTES = 64 << 20  # vectors of a block or slice, as doubles
PRODUCT_BYTES = 32 << 20  # similarities held at once


def vector_top_k(queries: DataFrame, corpus: DataFrame, query_id: str, query_vector: str, item_id: str, item_vector: str, k: int = 5) -> DataFrame:
    """(query_id, item_id, similarity, place): the ``k`` nearest corpus vectors per query, by cosine.

    Exact, for sides of any size: queries are cut into blocks and the corpus into slices, and each
    task multiplies one block with one slice and keeps k items per query. What leaves a task is
    ``k * QUERY_BLOCK`` rows, never the pairs. Blocks and slices are bounded in rows and in bytes,
    and a task multiplies a few queries at a time.
    """
    def cuts(rows: DataFrame, vector: str, most: int) -> int:
        n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vector)), F.lit(1))).first()
        return max(1, math.ceil(n / max(1, min(most, SLICE_BYTES // (8 * max(1, width))))))

    n_blocks, n_slices = cuts(queries, query_vector, QUERY_BLOCK), cuts(corpus, item_vector, CORPUS_SLICE)
    q = queries.select(F.col(query_id).alias("id"), F.col(query_vector).cast("array<double>").alias("v"))
    d = corpus.select(F.col(item_id).alias("id"), F.col(item_vector).cast("array<double>").alias("v"))
    q = q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    q = q.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))))
    d = d.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(n_slices)).cast("int"))
    d = d.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def unit(v: pd.Series) -> np.ndarray:
        m = np.stack(v.to_numpy())
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norm == 0, 1.0, norm)

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"q": [], "d": [], "similarity": []})
        right = right.sort_values("id", kind="stable")
        asked, items = unit(left["v"]), unit(right["v"]).T
        take = min(k, len(right))
        step = max(1, PRODUCT_BYTES // (8 * len(right)))
        cols, similarity = [], []
        for lo in range(0, len(left), step):
            scores = asked[lo:lo + step] @ items
            # stable: ties keep the ascending id
            order = np.argsort(-np.round(scores, 12), axis=1, kind="stable")[:, :take]
            cols.append(order.ravel())
            similarity.append(np.take_along_axis(scores, order, axis=1).ravel())
        return pd.DataFrame({
            "q": np.repeat(left["id"].to_numpy(), take), "d": right["id"].to_numpy()[np.concatenate(cols)], "similarity": np.concatenate(similarity),
        })

    kinds = dict(q.dtypes)["id"], dict(d.dtypes)["id"]
    scored = (
        q.groupBy("block", "slice").cogroup(d.groupBy("block", "slice"))
        .applyInPandas(nearest, f"q {kinds[0]}, d {kinds[1]}, similarity double")
    )
    best = W.partitionBy("q").orderBy(F.desc(F.round("similarity", 12)), F.asc("d"))
    return (
        scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
        .select(F.col("q").alias(query_id), F.col("d").alias(item_id), "similarity", "place")
    )
