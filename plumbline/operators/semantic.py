"""Business type per column: value shares first, then name words, then structure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import constants as K
from plumbline.functions.expressions import small
from plumbline.operators import metrics as M

SEMANTIC_METRICS = M.BASIC + M.TEXT_SHARES + M.RANGES + ["avg_length"]


def classification() -> Column:
    """(semantic_type, confidence) of a column, from its metrics; the first rule that holds wins."""
    c = F.col
    is_text = c("kind") == "text"
    is_number = c("kind").isin("integer", "float")
    every_row_distinct = (c("n_rows") >= 5) & (c("n_distinct") == c("n_rows"))

    def answer(kind: str | Column, confidence: float) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("semantic_type"), F.lit(confidence).alias("confidence"))

    rule = F.when(c("n_values") == 0, answer("free_text", 0.50))
    for metric, kind in [("n_email", "email"), ("n_phone", "phone"), ("n_url", "url"), ("n_postal", "postal_code"), ("n_ip", "ip_address"), ("n_date", "date_string")]:
        rule = rule.when(is_text & (c(metric) >= 0.70 * c("n_values")), answer(kind, 0.65))
    rule = rule.when(is_text & (c("n_boolean") >= 0.80 * c("n_values")), answer("boolean_text", 0.65))
    bounded = c("name_type").isin(list(K.SEMANTIC_RANGES)) & is_number
    rule = rule.when(bounded & (c("n_in_range") >= 0.90 * c("n_values")), answer(c("name_type"), 0.75))
    rule = rule.when(c("name_type").isNotNull(), answer(c("name_type"), 0.62))
    rule = rule.when(c("name_ends_id") & every_row_distinct, answer("identifier", 0.70))
    rule = rule.when(c("name_ends_id") | every_row_distinct, answer("identifier", 0.63))
    few = (c("n_values") >= 5) & c("n_distinct").between(2, 10) & (c("n_distinct") <= 0.40 * c("n_values"))
    rule = rule.when(is_text & few, answer("category", 0.60))
    rule = rule.when(is_text & (c("avg_length") > 50), answer("description", 0.55))
    return rule.otherwise(answer("free_text", 0.50))


def classify(metrics: DataFrame) -> DataFrame:
    """(column, semantic_type, confidence, method) from metrics with distinct counts."""
    return metrics.withColumn("_c", classification()).select(
        "ordinal", "column", F.col("_c.semantic_type").alias("semantic_type"),
        F.col("_c.confidence").alias("confidence"), F.lit("heuristic").alias("method"),
    )


def semantic_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    rows = M.with_distinct(M.column_metrics(df, columns, SEMANTIC_METRICS), df, columns)
    return classify(rows)


def merge(first: DataFrame, second: DataFrame, method: str = "given") -> DataFrame:
    """Two classifications: the second wins only with a strictly higher confidence."""
    a = first.select("column", F.struct("semantic_type", "confidence", "method").alias("a"))
    b = second.select("column", F.struct("semantic_type", "confidence", F.lit(method).alias("method")).alias("b"))
    joined = a.join(b, "column", "full_outer")
    second_wins = F.col("a").isNull() | (F.col("b.confidence") > F.coalesce(F.col("a.confidence"), F.lit(0.0)))
    pick = F.when(second_wins & F.col("b").isNotNull(), F.col("b")).otherwise(F.col("a"))
    return joined.select("column", pick.alias("p")).select("column", "p.*")


def schema_export(profile: DataFrame, semantic: DataFrame) -> DataFrame:
    """Profile and business types side by side, with the share of classified columns."""
    sem = semantic.select("column", "semantic_type", "confidence")
    rows = profile.join(small(sem), "column", "left")
    coverage = profile.join(small(sem), "column", "left").agg(
        F.round(100.0 * F.count("semantic_type") / F.count(F.lit(1)), 1).alias("coverage")
    )
    return rows.select(
        "column", "dtype", "inferred_type", "semantic_type", "confidence", "null_percentage", "unique_count",
        coverage.scalar().alias("semantic_coverage"),
    )
