"""Statistical profile of a table: counts, moments, quantiles, inferred types, distributions."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import predicates as P
from plumbline.functions import pvalues
from plumbline.functions.expressions import percent, small
from plumbline.operators import metrics as M
from plumbline.operators.evidence import sample_of_columns
from plumbline.operators.frequencies import distinct_counts, plain_columns, top_values, value_frequencies
from plumbline.operators.ordering import quantiles

PROFILE_METRICS = M.BASIC + M.NUMERIC + ["n_date", "avg_length", "n_true", "size_bytes"]


def inferred_type() -> Column:
    """Technical type of a column, from its metrics."""
    c = F.col
    return (
        F.when(c("kind") != "text", c("kind"))
        .when(c("n_values") == 0, "empty")
        .when((c("n_distinct") < 50) | (c("n_distinct") / c("n_values") < 0.05), "categorical")
        .when(c("n_date") == c("n_values"), "datetime_string")
        .when(c("avg_length") > 100, "text_long")
        .when(c("avg_length") > 30, "text_short")
        .when(c("n_distinct") == c("n_values"), "identifier")
        .otherwise("categorical_high_cardinality")
    )


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: D3 of the data model, without sample values (see ``sample_values``).

    One scan for the metrics and one for the value frequencies, which give both the exact distinct
    counts and the exact quartiles.
    """
    columns = list(columns or plain_columns(df))
    freq = value_frequencies(df, columns, digest_over=64)
    distinct = distinct_counts(freq).select("column", "n_distinct")
    quartiles = quantiles(freq.where(F.col("number").isNotNull()).select("column", "number", "n"), ["column"], [0.25, 0.5, 0.75])
    rows = (
        M.column_metrics(df, columns, PROFILE_METRICS)
        .join(small(distinct), "column", "left")
        .join(small(quartiles), "column", "left")
        .withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0).cast("bigint")))
    )
    c = F.col
    return rows.select(
        "ordinal", "column", "dtype", inferred_type().alias("inferred_type"),
        c("n_rows").alias("row_count"), c("n_values").alias("count"),
        (c("n_rows") - c("n_values")).alias("null_count"),
        percent(c("n_rows") - c("n_values"), c("n_rows")).alias("null_percentage"),
        c("n_distinct").alias("unique_count"), percent(c("n_distinct"), c("n_rows")).alias("unique_percentage"),
        "mean", "std", "min", "max",
        F.get("quantiles", F.lit(0)).alias("q25"), F.get("quantiles", F.lit(1)).alias("q50"), F.get("quantiles", F.lit(2)).alias("q75"),
        c("n_true").alias("true_count"), "size_bytes",
    )


def column_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, nulls and distinct values per column."""
    c = F.col
    rows = M.with_distinct(M.column_metrics(df, columns, M.BASIC), df, columns)
    return rows.select(
        "column", c("n_values").alias("count"), (c("n_rows") - c("n_values")).alias("null_count"),
        percent(c("n_rows") - c("n_values"), c("n_rows")).alias("null_percentage"),
        c("n_distinct").alias("unique_count"), percent(c("n_distinct"), c("n_rows")).alias("unique_percentage"),
    )


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Moments, extremes and exact quantiles of the numeric columns."""
    columns = [c for c in (columns or plain_columns(df)) if P.is_numeric(df.schema[c].dataType)]
    freq = value_frequencies(df, columns).select("column", "number", "n")
    rows = M.column_metrics(df, columns, M.BASIC + M.NUMERIC)
    return rows.join(small(quantiles(freq, ["column"], probs)), "column", "left").select(
        "column", F.col("n_values").alias("count"), "mean", "std", "min", "max", "quantiles"
    )


def table_totals(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, columns, null cells and bytes of a table (or one per ``by``), from its column metrics."""
    return metrics.groupBy(*by).agg(
        F.max("n_rows").alias("row_count"), F.count(F.lit(1)).alias("column_count"),
        F.sum(F.col("n_rows") - F.col("n_values")).alias("total_null_count"),
        F.sum("size_bytes").alias("size_bytes"),
    )


def size_estimate(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Bytes of data per column: text by its octets, other types by their width."""
    return M.column_metrics(df, columns, M.BASIC + ["size_bytes"]).select("column", "size_bytes")


def sample_values(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """(column, _k0..., value): the first ``k`` non-null values per column in ``key`` order, from one scan."""
    rows = sample_of_columns(df, key, columns, k)
    return rows.select("column", *[F.col(f"`{x}`").alias(f"_k{i}") for i, x in enumerate(key)], "value")


def content_hash(df: DataFrame) -> DataFrame:
    """Order-independent fingerprint: schema digest, row count and sums of two row hashes, which see where a row has nulls."""
    columns = plain_columns(df)
    schema = "|".join(f"{n}:{t}" for n, t in sorted(df.select(*columns).dtypes))
    cols = [F.col(f"`{c}`") for c in columns]
    cols.append(F.array(*[x.isNull() for x in cols]))  # a hash passes over nulls
    return df.agg(
        F.lit(hashlib.md5(schema.encode()).hexdigest()).alias("schema_hash"),
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).cast("string").alias("row_hash"),
        F.sum(F.xxhash64(F.lit("second"), *cols).cast("decimal(38,0)")).cast("string").alias("row_hash_2"),
    )


def frequent_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Mode (place 1) and top ``k`` values per column, with their counts."""
    rows = top_values(value_frequencies(df, columns), k)
    value = F.coalesce(F.col("text"), F.col("number").cast("string"))
    return rows.select("column", F.col("place").cast("int").alias("place"), value.alias("value"), "n")


def category_distribution(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """Distinct values, mode, its frequency and the top ``k`` of text columns."""
    freq = value_frequencies(df, columns)
    counts = distinct_counts(freq)
    top = top_values(freq, k)
    value = F.coalesce(F.col("text"), F.col("number").cast("string"))
    return top.join(small(counts), "column").select(
        "column", F.col("n_distinct").alias("unique_values"), F.col("place").cast("int").alias("place"),
        value.alias("value"), "n", (F.col("n") / F.col("n_values")).alias("share"),
    )


def shape(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Skewness, excess kurtosis, normality (D'Agostino K2, whole column) and a label per column."""
    columns = [c for c in (columns or plain_columns(df)) if P.is_numeric(df.schema[c].dataType)]
    rows = M.column_metrics(df, columns, M.BASIC + ["skewness", "kurtosis", "min", "max"])
    c = F.col
    k2, p = pvalues.dagostino(c("skewness"), c("kurtosis"), c("n_values"))
    enough = (c("n_values") >= 20) & c("skewness").isNotNull() & ~F.isnan("skewness")
    rows = rows.withColumn("normality_statistic", F.when(enough, k2)).withColumn("normality_pvalue", F.when(enough, p))
    return rows.select(
        "column", c("n_values").alias("count"), "skewness", "kurtosis", "normality_statistic", "normality_pvalue",
        (c("normality_pvalue") > 0.05).alias("is_normal"),
        F.when(c("min") == c("max"), "constant").otherwise(distribution_label(c("skewness"), c("kurtosis"), c("normality_pvalue"))).alias("distribution_type"),
    )


def distribution_label(skewness: Column, kurtosis: Column, pvalue: Column) -> Column:
    return (
        F.when(pvalue > 0.05, "approximately_normal")
        .when(skewness > 1, "right_skewed")
        .when(skewness < -1, "left_skewed")
        .when(kurtosis > 1, "heavy_tailed")
        .when(kurtosis < -1, "light_tailed")
        .otherwise("non_normal")
    )


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between the extremes, empty ones included."""
    x = P.col(P.as_double(column, df.schema[column].dataType))
    values = df.select(x.alias("x")).where(F.col("x").isNotNull())
    ends = values.agg(F.struct(F.min("x").alias("low"), F.max("x").alias("high")).alias("ends"))
    # the scalar subquery is one row, computed once and inlined
    marked = values.withColumn("ends", ends.scalar())
    low, high = F.col("ends.low"), F.col("ends.high")
    width = (high - low) / bins
    slot = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("x") - low) / width))).otherwise(F.lit(0))
    counted = marked.groupBy(slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.col("ends"))
    return frame.join(counted, "bin", "left").select(
        F.lit(column).alias("column"), "bin",
        (low + F.col("bin") * width).alias("bin_start"), (low + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )
