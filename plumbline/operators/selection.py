"""The first n rows of an order, for any n, without a task that receives n rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

AT_ONCE = 10_000  # so few rows may meet in one task
LEAST_PIECES = 32

c = F.col


def smallest_rows(df: DataFrame, order: Sequence[Column | str], n: int, at_once: int = AT_ONCE, pieces: int | None = None) -> DataFrame:
    """The first ``n`` rows (all, if there are fewer) in ascending ``order``, nulls first.

    Up to ``at_once`` rows Spark takes the first of every task and merges them. Beyond it the key of
    the last wanted row is found first: the keys alone are cut into ranges, counted, and the range that
    holds the n-th is cut again, until it is small. What lies below needs no order, just a filter; only
    the last range is sorted. ``order`` should tell rows apart: of rows that tie at the end, any are taken.
    """
    order = [c(f"`{x}`") if isinstance(x, str) else x for x in order]
    if n <= at_once:
        return df.orderBy(*order).limit(max(n, 0))
    pieces = pieces or max(LEAST_PIECES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(*[x.alias(f"k{i}") for i, x in enumerate(order)])
    rest, kept, low, size_before = df.select(key.alias("key")), 0, None, None

    def between(rows_key: Column, above: Column | None, upto: Column) -> Column:
        return rows_key <= upto if above is None else (rows_key > above) & (rows_key <= upto)

    while True:
        found = cut_lineage(
            rest.repartitionByRange(pieces, "key").groupBy(F.spark_partition_id().alias("piece"))
            .agg(F.max("key").alias("top"), F.min("key").alias("bottom"), F.count(F.lit(1)).alias("n"))
        )  # facts of the data, whatever bounds Spark has sampled: equal keys share a range
        at = None
        for r in found.select("piece", "n", (c("top") == c("bottom")).alias("one_key")).orderBy("piece").collect():  # at most ``pieces`` rows
            if kept + r["n"] > n:
                at = r
                break
            kept, low = kept + r["n"], found.where(c("piece") == r["piece"]).select("top").scalar()
        if at is None:
            return df
        whole = None if low is None else df.where(key <= low)
        if kept == n:
            return whole
        top = found.where(c("piece") == at["piece"]).select("top").scalar()
        if at["n"] <= at_once or at["one_key"] or at["n"] == size_before:
            last = df.where(between(key, low, top)).orderBy(*order).limit(n - kept)
            return last if whole is None else whole.unionByName(last)
        rest, size_before = rest.where(between(c("key"), low, top)), at["n"]
