"""Global order statistics without a one-task window.

A window ordered over a whole column would pull the column into one task. Here the distinct values
are cut into buckets of nearly equal size by sketched quantiles; values are ordered inside a bucket,
and each bucket adds the total of the buckets before it. The sketch only balances the work: results
are exact whatever the bounds are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.expressions import slots_below, small
from plumbline.session import cut_lineage

def default_bits(df: DataFrame) -> int:
    """2**bits buckets per column: about two per shuffle partition, 32 to 1024 of them."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(10, max(5, math.ceil(math.log2(2 * partitions))))


def bucketed(freq: DataFrame, by: Sequence[str], value: str = "number", bits: int | None = None) -> DataFrame:
    """``freq`` (distinct ``value`` per ``by``) with its ``bucket`` number, ascending in ``value``."""
    bits = bits or default_bits(freq)
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    bounds = freq.groupBy(*by).agg(F.percentile_approx(value, cuts, 10_000).alias("bounds"))
    return (
        freq.join(small(bounds), list(by))
        .withColumn("bucket", slots_below(F.col("bounds"), F.col(value), bits))
        .drop("bounds")
    )


def bucket_offsets(buckets: DataFrame, by: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """Per bucket: its totals and the totals before it. At most 2**bits rows per ``by``."""
    totals = buckets.groupBy(*by, "bucket").agg(*[F.sum(w).alias(f"{w}_in") for w in weights])
    before = W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        "*", *[F.coalesce(F.sum(f"{w}_in").over(before), F.lit(0)).alias(f"{w}_start") for w in weights]
    )


def _inside(buckets: DataFrame, offsets: DataFrame, by: Sequence[str], value: str, weights: Sequence[str]) -> DataFrame:
    before = W.partitionBy(*by, "bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    local = buckets.select(
        "*", *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"{w}_local") for w in weights]
    )
    joined = local.join(small(offsets.select(*by, "bucket", *[f"{w}_start" for w in weights])), [*by, "bucket"])
    out = joined.select("*", *[(F.col(f"{w}_start") + F.col(f"{w}_local")).alias(f"{w}_before") for w in weights])
    return out.drop("bucket", *[f"{w}_local" for w in weights], *[f"{w}_start" for w in weights])


def cumulative(freq: DataFrame, by: Sequence[str], value: str = "number", weights: Sequence[str] = ("n",), bits: int | None = None) -> DataFrame:
    """``freq`` plus ``<weight>_before``: the sum of each weight over smaller values of the same ``by``."""
    buckets = bucketed(freq, by, value, bits)
    return _inside(buckets, bucket_offsets(buckets, by, weights), by, value, weights)


def quantiles(freq: DataFrame, by: Sequence[str], probs: Sequence[float], value: str = "number", weight: str = "n", bits: int | None = None) -> DataFrame:
    """Exact, linearly interpolated quantiles: (by..., quantiles array, in the order of ``probs``).

    Only the buckets that hold a wanted position are sorted, so this costs one pass over the
    frequencies and a sort of about ``2 * len(probs) / 2**bits`` of them.
    """
    by = list(by)
    freq = freq.where(F.col(weight) > 0)
    buckets = bucketed(freq, by, value, bits)
    offsets = bucket_offsets(buckets, by, [weight])
    start, inside = F.col(f"{weight}_start"), F.col(f"{weight}_in")
    total = W.partitionBy(*by)

    spots = offsets.withColumn("total", F.sum(inside).over(total)).select(
        *by, "bucket", start.alias("start"), inside.alias("inside"),
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("i"), ((F.col("total") - 1) * F.lit(p)).alias("at")) for i, p in enumerate(probs)
        ])).alias("spot"),
    )
    low = F.floor(F.col("spot.at")).cast("long")
    spots = spots.select(
        *by, "bucket", "start", "inside",
        F.explode(F.array(
            F.struct(F.col("spot.i").alias("i"), F.lit(0).alias("side"), low.alias("position"), (F.col("spot.at") - low).alias("share")),
            F.struct(F.col("spot.i").alias("i"), F.lit(1).alias("side"), F.ceil(F.col("spot.at")).cast("long").alias("position"), (F.col("spot.at") - low).alias("share")),
        )).alias("want"),
    ).where((F.col("want.position") >= F.col("start")) & (F.col("want.position") < F.col("start") + F.col("inside")))
    wanted = spots.groupBy(*by, "bucket", "start").agg(F.collect_list("want").alias("wants"))  # <= 2 * len(probs)

    ordered = buckets.join(small(wanted), [*by, "bucket"])
    before = W.partitionBy(*by, "bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ordered = ordered.withColumn("before", F.col("start") + F.coalesce(F.sum(weight).over(before), F.lit(0)))
    hits = ordered.select(
        *by, F.col(value).alias("v"), "before", F.col(weight).alias("w"), F.explode("wants").alias("want")
    ).where((F.col("want.position") >= F.col("before")) & (F.col("want.position") < F.col("before") + F.col("w")))

    def side(i: int, s: int):
        return F.max(F.when((F.col("want.i") == i) & (F.col("want.side") == s), F.col("v")))

    def share(i: int):
        return F.max(F.when(F.col("want.i") == i, F.col("want.share")))

    return hits.groupBy(*by).agg(F.array(*[
        side(i, 0) + (side(i, 1) - side(i, 0)) * share(i) for i in range(len(probs))
    ]).alias("quantiles"))


def positions(df: DataFrame, keys: Sequence[str], weight: str | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` plus ``position``: its place (or the weight before it) in the order of ``keys``.

    For orders over several columns. Spark range-partitions and sorts; the rows with their partition
    number are written to the checkpoint folder, since a second run would sample other bounds.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    w = F.lit(1) if weight is None else F.col(weight)
    ranged = cut_lineage(
        df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id())
        .sortWithinPartitions(*keys)
    )
    totals = ranged.groupBy("_part").agg(F.sum(w).alias("_total"))
    start = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(start), F.lit(0)).alias("_start"))
    before = W.partitionBy("_part").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(w).over(before), F.lit(0)))
    return (
        local.join(small(offsets), "_part")
        .withColumn("position", F.col("_start") + F.col("_local"))
        .drop("_part", "_start", "_local")
    )
