"""Drift between a reference table and a current one, for all shared columns at once.

Both sides are folded into value frequencies first: (column, value, n_ref, n_cur). Every test below
is a function of that table, so the rows are read once and a hot value is one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import predicates as P
from plumbline.functions import pvalues
from plumbline.functions.constants import PSI_LEVELS
from plumbline.functions.expressions import slots_below, small
from plumbline.operators.checks import details, finish, issue
from plumbline.operators.frequencies import cells, plain_columns
from plumbline.operators.ordering import cumulative, quantiles

c = F.col
EPSILON = 1e-10
NOT_TESTED = "not enough rows"  # a side without values


def shared_columns(reference: DataFrame, current: DataFrame, numeric: bool | None = None) -> list[str]:
    both = [x for x in plain_columns(reference) if x in current.columns]
    if numeric is None:
        return both
    return [x for x in both if P.is_numeric(reference.schema[x].dataType) == numeric]


def paired_frequencies(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, number, text, n_ref, n_cur), one row per value seen on either side."""
    def side(df: DataFrame, tag: int) -> DataFrame:
        long = df.select(F.explode(cells(df, columns)).alias("cell")).select("cell.*")
        return long.where(c("number").isNotNull() | c("text").isNotNull()).withColumn("cur", F.lit(tag))

    both = side(reference, 0).unionByName(side(current, 1))
    return both.groupBy("column", "number", "text").agg(
        F.sum(1 - c("cur")).alias("n_ref"), F.sum("cur").alias("n_cur")
    )


def _totals(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("column").agg(F.sum("n_ref").alias("total_ref"), F.sum("n_cur").alias("total_cur"))


def kolmogorov_smirnov(pairs: DataFrame) -> DataFrame:
    """(column, statistic, p_value, total_ref, total_cur): largest gap of the two distribution functions."""
    ordered = cumulative(pairs, ["column"], "number", ["n_ref", "n_cur"]).join(small(_totals(pairs)), "column")
    gap = F.abs(
        F.try_divide(c("n_ref_before") + c("n_ref"), c("total_ref")) - F.try_divide(c("n_cur_before") + c("n_cur"), c("total_cur"))
    )
    rows = ordered.groupBy("column", "total_ref", "total_cur").agg(F.max(gap).alias("statistic"))
    return rows.withColumn("p_value", F.when(c("statistic").isNotNull(), pvalues.kolmogorov(c("statistic"), c("total_ref"), c("total_cur"))))


def reference_edges(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """(column, edges): distinct reference quantiles; equal-width edges where they collapse."""
    probs = [i / bins for i in range(bins + 1)]
    rows = quantiles(pairs.where(c("n_ref") > 0), ["column"], probs, "number", "n_ref")
    edges = F.array_distinct("quantiles")
    low = F.get("quantiles", F.lit(0))
    # one distinct value: pandas widens the range by 0.1 % of it on both sides, or 0.001 at zero
    spread = F.when(low == 0, 0.001).otherwise(0.001 * F.abs(low))
    even = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: low - spread + i * (2.0 * spread / bins))
    return rows.select("column", F.when(F.size(edges) >= 2, edges).otherwise(even).alias("edges"))


def binned(pairs: DataFrame, edges: DataFrame, bins: int = 10) -> DataFrame:
    """(column, bin, n_ref, n_cur) over the reference's bins; values outside the edges are left out."""
    bits = (bins + 1).bit_length()
    top = F.element_at("edges", -1)
    padded = F.concat(c("edges"), F.array_repeat(F.lit(float("inf")), (1 << bits) - 1 - F.size("edges")))
    rows = pairs.join(small(edges.withColumn("padded", padded)), "column")
    inside = (c("number") >= F.get("edges", F.lit(0))) & (c("number") <= top)
    slot = F.greatest(F.lit(1), slots_below(c("padded"), c("number"), bits))
    counted = rows.where(inside).groupBy("column", slot.alias("bin")).agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    frame = edges.select("column", F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bin"))
    return frame.join(counted, ["column", "bin"], "left").fillna(0, ["n_ref", "n_cur"])


def psi_from_bins(bins: DataFrame, totals: DataFrame) -> DataFrame:
    rows = bins.join(small(totals), "column")
    r, q = F.try_divide("n_ref", "total_ref") + EPSILON, F.try_divide("n_cur", "total_cur") + EPSILON
    return rows.groupBy("column").agg(F.sum((q - r) * F.log(q / r)).alias("psi"))


def population_stability(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """(column, psi) over the deciles of the reference, matched interval by interval."""
    return psi_from_bins(binned(pairs, reference_edges(pairs, bins), bins), _totals(pairs))


def numeric_severity(p_value: Column, psi: Column, alpha: float = 0.05) -> Column:
    low, medium, high = PSI_LEVELS
    return (
        F.when((p_value >= alpha) & (psi < low), "none").when(psi < low, "low").when(psi < medium, "medium")
        .when(psi < high, "high").otherwise("critical")
    )


def category_severity(p_value: Column, alpha: float = 0.05) -> Column:
    return (
        F.when(p_value >= alpha, "none").when(p_value >= 0.01, "low").when(p_value >= 0.001, "medium")
        .when(p_value >= 0.0001, "high").otherwise("critical")
    )


def numeric_drift(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(column, test_used, statistic, p_value, psi, drift_score, severity, has_drift) of numeric columns."""
    rows = kolmogorov_smirnov(pairs).join(small(population_stability(pairs)), "column", "left")
    tested = c("p_value").isNotNull() & c("psi").isNotNull()
    severity = F.when(tested, numeric_severity(c("p_value"), c("psi"), alpha)).otherwise("none")
    return rows.select(
        "column", F.when(tested, "KS-test + PSI").otherwise(NOT_TESTED).alias("test_used"), "statistic", "p_value", "psi",
        F.least(F.lit(1.0), c("psi") / PSI_LEVELS[2]).alias("drift_score"), severity.alias("severity"),
        (severity != "none").alias("has_drift"), c("total_ref"), c("total_cur"),
    )


def chi_squared(pairs: DataFrame, on_shares: bool = False) -> DataFrame:
    """(column, statistic, freedom, p_value). ``on_shares`` takes shares instead of counts, as if n were 1."""
    rows = pairs.join(small(_totals(pairs)), "column")
    if on_shares:
        k = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("k"))
        rows = rows.join(small(k), "column")
        r = (c("n_ref") + EPSILON) / (c("total_ref") + c("k") * EPSILON)
        q = (c("n_cur") + EPSILON) / (c("total_cur") + c("k") * EPSILON)
        term = (q - r) * (q - r) / r
    else:
        both = c("n_ref") + c("n_cur")
        everything = c("total_ref") + c("total_cur")
        e_ref, e_cur = both * c("total_ref") / everything, both * c("total_cur") / everything
        term = F.try_divide((c("n_ref") - e_ref) * (c("n_ref") - e_ref), e_ref) + F.try_divide((c("n_cur") - e_cur) * (c("n_cur") - e_cur), e_cur)
    out = rows.groupBy("column", "total_ref", "total_cur").agg(
        F.sum(term).alias("statistic"), (F.count(F.lit(1)) - 1).cast("double").alias("freedom")
    )
    p = F.when(c("statistic").isNull() | (c("total_ref") == 0) | (c("total_cur") == 0), None).when(c("freedom") <= 0, 1.0).otherwise(pvalues.chi_squared(c("statistic"), c("freedom")))
    return out.withColumn("p_value", p)


def categorical_drift(pairs: DataFrame, alpha: float = 0.05, on_shares: bool = False) -> DataFrame:
    tested = c("p_value").isNotNull()
    severity = F.when(tested, category_severity(c("p_value"), alpha)).otherwise("none")
    return chi_squared(pairs, on_shares).select(
        "column", F.when(tested, "Chi-squared").otherwise(NOT_TESTED).alias("test_used"), "statistic", "p_value", F.lit(None).cast("double").alias("psi"),
        F.least(F.lit(1.0), c("statistic") / 100.0).alias("drift_score"), severity.alias("severity"),
        (severity != "none").alias("has_drift"), "total_ref", "total_cur",
    )


def detect_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None,
                 alpha: float = 0.05, min_rows: int = 30) -> DataFrame:
    """Drift of every shared column: KS and PSI for numbers, chi-squared for the rest."""
    columns = list(columns or shared_columns(reference, current))
    turned = [x for x in columns if P.is_numeric(reference.schema[x].dataType) != P.is_numeric(current.schema[x].dataType)]
    numbers = [x for x in columns if x not in turned and P.is_numeric(reference.schema[x].dataType)]
    others = [x for x in columns if x not in turned and x not in numbers]
    parts = [_named_only(reference, turned, "type change", 1.0, "critical", True)]
    if numbers:
        parts.append(numeric_drift(paired_frequencies(reference, current, numbers), alpha))
    if others:
        parts.append(categorical_drift(paired_frequencies(reference, current, others), alpha))
    seen = reduce(DataFrame.unionByName, parts)
    every = _named_only(reference, numbers + others, NOT_TESTED, 0.0, "none", False)
    out = seen.unionByName(every.join(small(seen.select("column")), "column", "left_anti"))  # a column that is null on both sides
    # columns with too few values on a side are reported without a verdict
    enough = (c("test_used") == "type change") | (c("total_ref") >= min_rows) & (c("total_cur") >= min_rows)
    return out.withColumns({
        "severity": F.when(enough, c("severity")).otherwise("none"), "has_drift": enough & c("has_drift"),
        "test_used": F.when(enough, c("test_used")).otherwise("not enough rows"),
        "drift_score": F.when(enough, c("drift_score")).otherwise(0.0),
    })


def _named_only(df: DataFrame, columns: Sequence[str], test_used: str, score: float, severity: str, has_drift: bool) -> DataFrame:
    """A result row for each of ``columns`` without statistics."""
    schema = "column string, test_used string, statistic double, p_value double, psi double, drift_score double, severity string, has_drift boolean, total_ref bigint, total_cur bigint"
    return df.sparkSession.createDataFrame([(x, test_used, None, None, None, score, severity, has_drift, 0, 0) for x in columns], schema)


def drift_summary(results: DataFrame) -> DataFrame:
    worst = F.max_by("column", F.struct("drift_score", "column"))
    levels = [F.count(F.when(c("severity") == s, 1)).alias(f"n_{s}") for s in ("none", "low", "medium", "high", "critical")]
    return results.agg(
        F.count(F.lit(1)).alias("total_columns"), F.count(F.when(c("has_drift"), 1)).alias("columns_with_drift"),
        F.round(100.0 * F.count(F.when(c("has_drift"), 1)) / F.count(F.lit(1)), 1).alias("drift_percentage"),
        worst.alias("most_drifted_column"), F.max("drift_score").alias("max_drift_score"), *levels,
    )


def drift_issues(results: DataFrame, row_count: int | Column, dataset_id: str = "table") -> DataFrame:
    n = row_count if isinstance(row_count, Column) else F.lit(row_count)
    words = F.concat(F.lit("Column '"), c("column"), F.lit("' drifted ("), c("severity"), F.lit(")"))
    found = issue(
        "drift", "drift", c("severity"), n, F.lit(100.0), 1.0 - F.coalesce("p_value", F.lit(0.5)), words,
        details(drift_score=c("drift_score"), p_value=c("p_value"), test_used=c("test_used")),
    )
    return finish(results.where("has_drift").select("column", found.alias("i")).select("column", "i.*"), dataset_id)


def side_statistics(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, side, n, mean, std, min, max) of numeric columns, one aggregate per side."""
    def side(df: DataFrame, name: str) -> DataFrame:
        x = {col: P.col(P.as_double(col, df.schema[col].dataType)) for col in columns}
        row = df.agg(*[
            F.struct(F.lit(col).alias("column"), F.lit(name).alias("side"), F.count(v).alias("n"), F.avg(v).alias("mean"),
                     F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")).alias(str(i))
            for i, (col, v) in enumerate(x.items())
        ])
        return row.select(F.explode(F.array(*[F.col(str(i)) for i in range(len(columns))])).alias("s")).select("s.*")

    return side(reference, "reference").unionByName(side(current, "current"))


def numeric_changes(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean_change_percent, std_change_percent); null where the reference is 0."""
    stats = side_statistics(reference, current, columns)
    pick = lambda side, f: F.max(F.when(c("side") == side, c(f)))
    rows = stats.groupBy("column").agg(*[pick(s, f).alias(f"{f}_{s}") for s in ("reference", "current") for f in ("mean", "std")])

    def change(f: str) -> Column:
        ref = c(f"{f}_reference")
        return F.when(ref != 0, 100.0 * (c(f"{f}_current") - ref) / ref)

    return rows.select("column", change("mean").alias("mean_change_percent"), change("std").alias("std_change_percent"))


def quantile_changes(pairs: DataFrame, probs: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """(column, prob, reference, current, change) per quantile."""
    ref = quantiles(pairs, ["column"], probs, "number", "n_ref").withColumnRenamed("quantiles", "r")
    cur = quantiles(pairs, ["column"], probs, "number", "n_cur").withColumnRenamed("quantiles", "q")
    zipped = F.arrays_zip(F.array(*[F.lit(p) for p in probs]).alias("prob"), c("r"), c("q"))
    rows = ref.join(small(cur), "column").select("column", F.explode(zipped).alias("z"))
    return rows.select(
        "column", c("z")["prob"].alias("prob"), c("z.r").alias("reference"), c("z.q").alias("current"), (c("z.q") - c("z.r")).alias("change")
    )


def category_shares(pairs: DataFrame) -> DataFrame:
    """(column, category, n_ref, n_cur, reference, current, change): aligned category frequencies."""
    value = F.coalesce(c("text"), c("number").cast("string"))
    rows = pairs.join(small(_totals(pairs)), "column")
    ref, cur = F.try_divide("n_ref", "total_ref"), F.try_divide("n_cur", "total_cur")  # null for a side without values
    return rows.select(
        "column", value.alias("category"), "n_ref", "n_cur", ref.alias("reference"), cur.alias("current"), (cur - ref).alias("change")
    )


def category_changes(shares: DataFrame, minimum: float = 0.01, k: int = 10) -> DataFrame:
    """The ``k`` largest share changes above ``minimum`` per column."""
    order = W.partitionBy("column").orderBy(F.desc(F.round(F.abs("change"), 12)), "category")
    rows = shares.where(F.abs("change") > minimum).withColumn("place", F.row_number().over(order))
    return rows.where(c("place") <= k)


def category_top(shares: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent categories of each side: (column, side, place, category, share)."""
    sides = shares.select("column", "category", F.explode(F.array(
        F.struct(F.lit("reference").alias("side"), c("n_ref").alias("n"), c("reference").alias("share")),
        F.struct(F.lit("current").alias("side"), c("n_cur").alias("n"), c("current").alias("share")),
    )).alias("s")).select("column", "category", "s.*").where("n > 0")
    order = W.partitionBy("column", "side").orderBy(F.desc("n"), "category")
    return sides.withColumn("place", F.row_number().over(order)).where(c("place") <= k)


def new_and_removed(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, category, status): categories on one side only."""
    def values(df: DataFrame) -> DataFrame:
        long = df.select(F.explode(cells(df, columns)).alias("cell"))
        value = F.coalesce(c("cell.text"), c("cell.number").cast("string"))
        return long.select(c("cell.column").alias("column"), value.alias("category")).where("category is not null").distinct()

    ref, cur = values(reference), values(current)
    fresh = cur.join(ref, ["column", "category"], "left_anti").withColumn("status", F.lit("new"))
    gone = ref.join(cur, ["column", "category"], "left_anti").withColumn("status", F.lit("removed"))
    return fresh.unionByName(gone)


# A stored baseline: compare later without the reference rows

def baseline(reference: DataFrame, columns: Sequence[str] | None = None, bins: int = 10) -> dict[str, DataFrame]:
    """Reference bins of numeric columns, category counts of the others, and side statistics."""
    columns = list(columns or plain_columns(reference))
    numbers = [x for x in columns if P.is_numeric(reference.schema[x].dataType)]
    others = [x for x in columns if x not in numbers]
    nothing = reference.limit(0)
    out = {}
    if numbers:
        pairs = paired_frequencies(reference, nothing, numbers)
        edges = reference_edges(pairs, bins)
        counts = binned(pairs, edges, bins).select("column", "bin", "n_ref")
        out["bins"] = counts.join(small(edges), "column").join(small(_totals(pairs).select("column", "total_ref")), "column")
    if others:
        out["categories"] = paired_frequencies(reference, nothing, others).select("column", "text", "n_ref")
    return out


def psi_against_baseline(current: DataFrame, bins_table: DataFrame, bins: int = 10) -> DataFrame:
    """(column, psi) of ``current`` against a stored ``baseline()['bins']``."""
    columns = [r["column"] for r in bins_table.select("column").distinct().collect()]  # one row per column
    pairs = paired_frequencies(current.limit(0), current, columns)
    edges = bins_table.select("column", "edges").distinct()
    cur = binned(pairs, edges, bins).select("column", "bin", "n_cur")
    both = bins_table.select("column", "bin", "n_ref").join(cur, ["column", "bin"])
    totals = _totals(pairs).select("column", "total_cur").join(small(bins_table.select("column", "total_ref").distinct()), "column")
    return psi_from_bins(both, totals)
