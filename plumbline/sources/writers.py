"""Sinks: corrected tables, report tables, and sessions kept for later steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.scoring import score_band


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def save_session_input(df: DataFrame, path: str, session_id: str) -> None:
    """The analysed table of a session, kept so that corrections can be applied later."""
    df.write.mode("overwrite").parquet(f"{path}/input/session_id={session_id}")


def load_session_input(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    return spark.read.parquet(f"{path}/input/session_id={session_id}")


def save_results(results: dict[str, DataFrame], path: str, session_id: str) -> None:
    for name, table in results.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}/session_id={session_id}")


def load_results(spark: SparkSession, path: str, session_id: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}/session_id={session_id}") for name in names}


def report_tables(totals: DataFrame, issues: DataFrame, profile: DataFrame, scores: DataFrame, score: DataFrame) -> dict[str, DataFrame]:
    """The four sheets of a report: summary, issues, columns, column scores with their level."""
    c = F.col
    counts = issues.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("issues_count"))
    summary = score.join(counts, "dataset_id", "left").select(
        "dataset_id", "score", score_band(c("score")).alias("level"), F.coalesce("issues_count", F.lit(0)).alias("issues_count")
    ).join(totals, "dataset_id")
    return {
        "summary": summary,
        "issues": issues.select("dataset_id", "issue_type", "severity", "column", "description", "affected_count", "affected_percentage", "confidence"),
        "columns": profile.select(
            "column", "dtype", "inferred_type", "count", "null_count", "null_percentage", "unique_count", "unique_percentage", "min", "max",
            F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
        ),
        "column_scores": scores.select("dataset_id", "column", "score", score_band(c("score")).alias("level")).orderBy("score", "column"),
    }


def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "csv") -> None:
    for name, table in tables.items():
        write_table(table, f"{path}/{name}", fmt)
