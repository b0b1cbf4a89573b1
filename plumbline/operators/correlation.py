"""Pearson, Spearman and Kendall correlation of column pairs, exact on any number of rows."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import predicates as P
from plumbline.functions.expressions import bands, small
from plumbline.operators.frequencies import plain_columns
from plumbline.operators.ordering import cumulative, positions
from plumbline.operators.skew import hot_keys, join_spread
from plumbline.session import stored

c = F.col
PAIRS_PER_SCAN = 300
FEW = 4096  # distinct values of a side whose ranks are broadcast


def _number(df: DataFrame, name: str) -> Column:
    return P.col(P.as_double(name, df.schema[name].dataType))


def _pairs(df: DataFrame, columns: Sequence[str] | None) -> list[tuple[str, str]]:
    names = [x for x in (columns or plain_columns(df)) if P.is_numeric(df.schema[x].dataType)]
    return list(itertools.combinations(names, 2))


def labelled(rows: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Adds sign and strength to (column_1, column_2, correlation) and drops the weak pairs."""
    r = c("correlation")
    strength = bands(F.abs(r), [(0.9, "very_strong"), (0.7, "strong"), (0.5, "moderate")], "weak")
    return rows.where(F.abs(r) >= threshold).select(
        "column_1", "column_2", "correlation", F.when(r > 0, "positive").otherwise("negative").alias("direction"), strength.alias("strength")
    )


def _correlation(x: Column, y: Column) -> Column:
    """Pearson over the rows with both; null, not an error, where one of them does not vary."""
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


def pearson(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_1, column_2, correlation) of all pairs in one aggregate; a pair skips rows with a null. A constant column has none (null)."""
    pairs = _pairs(df, columns)
    names = list(dict.fromkeys(x for p in pairs for x in p))
    ends = [f(_number(df, x)).alias(f"{tag}{i}") for i, x in enumerate(names) for tag, f in (("low", F.min), ("high", F.max))]
    varies = {x: c(f"low{i}") < c(f"high{i}") for i, x in enumerate(names)}
    parts = []
    for start in range(0, len(pairs), PAIRS_PER_SCAN):
        chunk = pairs[start:start + PAIRS_PER_SCAN]
        row = df.agg(*[_correlation(_number(df, a), _number(df, b)).alias(str(i)) for i, (a, b) in enumerate(chunk)], *ends)
        parts.append(row.select(F.explode(F.array(*[
            F.struct(F.lit(a).alias("column_1"), F.lit(b).alias("column_2"), F.when(varies[a] & varies[b], F.col(str(i))).alias("correlation"))
            for i, (a, b) in enumerate(chunk)
        ])).alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, parts)


def joint_frequencies(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(pair, x, y, n) for all pairs, rows with a null left out pair by pair."""
    found = F.array(*[
        F.struct(F.lit(i).alias("pair"), (_number(df, a) + 0.0).alias("x"), (_number(df, b) + 0.0).alias("y"))
        for i, (a, b) in enumerate(pairs)
    ])
    long = df.select(F.explode(found).alias("p")).select("p.*").where(c("x").isNotNull() & c("y").isNotNull())
    return long.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("n"))


def _marginal(joint: DataFrame, axis: str) -> DataFrame:
    return joint.groupBy("pair", axis).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("fan"))


def _attach(rows: DataFrame, table: DataFrame, marginal: DataFrame, axis: str) -> DataFrame:
    """``rows`` (distinct x, y per pair) joined with ``table`` by (pair, axis), hot values spread."""
    hot = hot_keys(marginal.select("pair", axis, "fan"), ["pair", axis], "fan", ["pair"])
    return join_spread(rows, table, ["pair", axis], hot, ["x", "y"])


def spearman(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_1, column_2, correlation): Pearson of average ranks, ranked within each pair's complete rows.

    The ranks of the side with fewer distinct values are joined to the joint frequencies, which are then summed for each
    value of the other side, so that side is ranked in its sums and not joined.
    """
    pairs = _pairs(df, columns)
    joint = stored(joint_frequencies(df, pairs))
    sides = {r["pair"]: (r["x"], r["y"]) for r in joint.groupBy("pair").agg(*[F.approx_count_distinct(a).alias(a) for a in ("x", "y")]).collect()}  # a row for each pair
    turned = c("pair").isin([p for p, (x, y) in sides.items() if x < y])
    joint = joint.select("pair", F.when(turned, c("y")).otherwise(c("x")).alias("x"), F.when(turned, c("x")).otherwise(c("y")).alias("y"), "n")
    marginal = stored(_marginal(joint, "y"))
    centers = marginal.groupBy("pair").agg(((F.sum("n") + 1) / 2.0).alias("center"))
    rank = c("n_before") + (c("n") + 1) / 2.0
    ranks = stored(cumulative(marginal.drop("fan"), ["pair"], "y").join(small(centers), "pair").select("pair", "y", "n", (rank - c("center")).alias("dy")))
    few = c("pair").isin([p for p, both in sides.items() if min(both) <= FEW])
    rows = joint.where(few).join(small(ranks.where(few).select("pair", "y", "dy")), ["pair", "y"])
    if any(min(both) > FEW for both in sides.values()):
        rows = rows.unionByName(_attach(joint.where(~few), ranks.where(~few).select("pair", "y", "dy"), marginal.where(~few), "y"))
    sums = stored(rows.groupBy("pair", "x").agg(F.sum("n").alias("n"), F.sum(c("n") * c("dy")).alias("s")))
    spread = ranks.groupBy("pair").agg(F.sum(c("n") * c("dy") * c("dy")).alias("yy"))
    dx = rank - c("center")
    out = cumulative(sums, ["pair"], "x").join(small(centers.join(spread, "pair")), "pair").groupBy("pair").agg(
        F.try_divide(F.sum(c("s") * dx), F.sqrt(F.sum(c("n") * dx * dx) * F.first("yy"))).alias("correlation")
    )
    return _named(out, pairs)


def _named(rows: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    names = F.array(*[F.struct(F.lit(a).alias("column_1"), F.lit(b).alias("column_2")) for a, b in pairs])
    return rows.withColumn("_n", F.get(names, c("pair"))).select("_n.column_1", "_n.column_2", "correlation")


def kendall(df: DataFrame, first: str, second: str, slices: int | None = None) -> DataFrame:
    """(column_1, column_2, correlation): tau-b by an exact count of the inversions.

    With rows in (x, y) order, an inversion is a pair whose y falls. Written in binary, two y ranks
    first differ at one bit: so per bit, among rows with equal higher bits, count the rows with the
    bit set that precede rows without it. Each count is a running sum, cut into ``slices`` of the
    order so that no group of rows is summed by one task.
    """
    slices = slices or max(128, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    joint = joint_frequencies(df, [(first, second)])
    y_rank = cumulative(_marginal(joint, "y").withColumn("one", F.lit(1)), ["pair"], "y", ["one"])
    ranked = _attach(joint, y_rank.select("pair", "y", c("one_before").cast("long").alias("rank")), _marginal(joint, "y"), "y")
    placed = positions(ranked, ["x", "y"])  # checkpointed: the counts below read it again
    head = placed.agg(F.count(F.lit(1)), F.max("rank")).first()
    size, top = head[0], head[1] or 0
    bits = max(1, int(top).bit_length())
    step = max(1, math.ceil(size / slices))
    by_bit = placed.select(
        F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"), "rank", "position", "n",
        F.floor(c("position") / step).alias("slice"),
    ).select(
        "bit", F.expr("shiftright(rank, bit + 1)").alias("prefix"), "slice", "position",
        F.when(F.expr("shiftright(rank, bit) % 2 = 1"), c("n")).otherwise(0).alias("ones"),
        F.when(F.expr("shiftright(rank, bit) % 2 = 0"), c("n")).otherwise(0).alias("zeros"),
    )
    group = ["bit", "prefix", "slice"]
    earlier = W.partitionBy("bit", "prefix").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_bit.groupBy(*group).agg(F.sum("ones").alias("_in")).withColumn("_start", F.coalesce(F.sum("_in").over(earlier), F.lit(0)))
    inside = W.partitionBy(*group).orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    local = by_bit.withColumn("_local", F.coalesce(F.sum("ones").over(inside), F.lit(0)))
    big = "decimal(38,0)"
    discordant = local.join(offsets, group).agg(
        F.sum(c("zeros").cast("decimal(18,0)") * (c("_start") + c("_local")).cast("decimal(18,0)")).cast(big).alias("d")
    )

    def ties(rows: DataFrame, name: str) -> DataFrame:
        n = c("n").cast("decimal(18,0)")
        return rows.agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0)).cast("double").alias(name)).select(name)

    n_all = joint.agg(F.sum("n").alias("n"))
    return discordant.select(
        c("d").cast("double").alias("d"), ties(n_all, "t").scalar().alias("n0"), ties(_marginal(joint, "x"), "t").scalar().alias("n1"),
        ties(_marginal(joint, "y"), "t").scalar().alias("n2"), ties(joint, "t").scalar().alias("n3"),
    ).select(
        F.lit(first).alias("column_1"), F.lit(second).alias("column_2"),
        F.try_divide(c("n0") - c("n1") - c("n2") + c("n3") - 2 * c("d"), F.sqrt((c("n0") - c("n1")) * (c("n0") - c("n2")))).alias("correlation"),
    )
