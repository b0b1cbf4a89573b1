"""History over an append-only table of sessions: trends, recurring problems, dashboard figures.

``sessions``: (dataset_id, session_id, ts, quality_score, row of counts); ``issues`` carries the same
ids. Every history figure is a query over these two.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.expressions import bands

c = F.col
KEPT_SESSIONS = 10
SUGGESTION_SHARE = 0.6
TREND_SESSIONS = 3
TREND_DELTA = 5.0


def dataset_id(df: DataFrame) -> str:
    """Identity of a table: digest of its sorted column names and types."""
    schema = "|".join(f"{n}:{t}" for n, t in sorted(df.dtypes))
    return "dataset_" + hashlib.md5(schema.encode()).hexdigest()[:12]


def dataset_id_of(columns: DataFrame) -> DataFrame:
    """The same digest for many tables given as rows (table, column, dtype)."""
    entries = F.array_sort(F.collect_list(F.struct("column", "dtype")))  # one entry per schema column
    text = F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["column"], x["dtype"])), "|")
    return columns.groupBy("table").agg(entries.alias("e")).select("table", F.concat(F.lit("dataset_"), F.md5(text).substr(1, 12)).alias("dataset_id"))


def session_row(issues: DataFrame, scores: DataFrame, session_id: str, ts: str) -> DataFrame:
    """One session per dataset: score, issue counts by type, first five columns with issues."""
    by_type = issues.groupBy("dataset_id", "issue_type").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("column")).alias("cols"))
    folded = by_type.groupBy("dataset_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("issue_type", "n")))).alias("issue_counts"),
        F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("cols")))), 1, 5).alias("top_columns"), F.sum("n").alias("issues_count"),
    )
    return scores.join(folded, "dataset_id", "left").select(
        "dataset_id", F.lit(session_id).alias("session_id"), F.lit(ts).cast("timestamp").alias("ts"), c("score").alias("quality_score"),
        F.coalesce("issues_count", F.lit(0)).alias("issues_count"), "issue_counts", "top_columns",
    )


def record_session(issues: DataFrame, scores: DataFrame, session_id: str, ts: str, path: str) -> None:
    session_row(issues, scores, session_id, ts).write.mode("append").parquet(path)


def recent_sessions(sessions: DataFrame, k: int = KEPT_SESSIONS) -> DataFrame:
    """The last ``k`` sessions per dataset; ``place`` 1 is the newest. Spark limits per task first."""
    newest = W.partitionBy("dataset_id").orderBy(F.desc("ts"), F.desc("session_id"))
    return sessions.withColumn("place", F.row_number().over(newest)).where(c("place") <= k)


def trends(sessions: DataFrame) -> DataFrame:
    """(dataset_id, kept, last_score, previous_avg, trend) over the kept sessions."""
    kept = recent_sessions(sessions).groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("kept"), F.max(F.when(c("place") == 1, c("quality_score"))).alias("last_score"),
        F.avg(F.when(c("place") > 1, c("quality_score"))).alias("previous_avg"),
    )
    return kept.withColumn("trend", trend(c("kept"), c("last_score"), c("previous_avg")))


def trend(kept: Column, last: Column, previous: Column) -> Column:
    return (
        F.when(kept <= 1, "new").when(kept < TREND_SESSIONS, "stable").when(last > previous + TREND_DELTA, "improving")
        .when(last < previous - TREND_DELTA, "degrading").otherwise("stable")
    )


def dataset_history(sessions: DataFrame) -> DataFrame:
    """(dataset_id, session_count, avg_quality_score, first_seen, last_seen, trend)."""
    totals = sessions.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("session_count"), F.round(F.avg("quality_score"), 2).alias("avg_quality_score"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )
    return totals.join(trends(sessions).select("dataset_id", "trend"), "dataset_id")


def recurring_issue_types(issues: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most frequent issue types per dataset: (dataset_id, issue_type, n, place)."""
    counts = issues.groupBy("dataset_id", "issue_type").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("dataset_id").orderBy(F.desc("n"), "issue_type")
    return counts.withColumn("place", F.row_number().over(order)).where(c("place") <= k)


def problem_columns(issues: DataFrame) -> DataFrame:
    """(dataset_id, column, sessions): in how many sessions a column had an issue."""
    once = issues.where(c("column").isNotNull()).select("dataset_id", "column", "session_id").distinct()
    return once.groupBy("dataset_id", "column").agg(F.count(F.lit(1)).alias("sessions"))


def suggested_rules(sessions: DataFrame, issues: DataFrame) -> DataFrame:
    """(dataset_id, column, rule_kind, share) for problems in more than 60 % of the sessions.

    Missing values suggest a not-null rule and format errors a strict format, on each column with
    trouble in that many sessions; a falling score suggests an audit.
    """
    totals = sessions.groupBy("dataset_id").agg(F.countDistinct("session_id").alias("total"))
    types = issues.where(c("issue_type").isin("missing_values", "format_error")).select("dataset_id", "issue_type", "session_id").distinct()
    types = types.groupBy("dataset_id", "issue_type").agg(F.count(F.lit(1)).alias("hit")).join(totals, "dataset_id")
    types = types.where(c("hit") / c("total") > SUGGESTION_SHARE).select("dataset_id", "issue_type")
    columns = problem_columns(issues).join(totals, "dataset_id").withColumn("share", c("sessions") / c("total")).where(c("share") > SUGGESTION_SHARE)
    kind = F.when(c("issue_type") == "missing_values", "not_null").otherwise("strict_format")
    by_column = types.join(columns, "dataset_id").select("dataset_id", "column", kind.alias("rule_kind"), "share")
    audits = trends(sessions).where(c("trend") == "degrading").select(
        "dataset_id", F.lit(None).cast("string").alias("column"), F.lit("audit").alias("rule_kind"), F.lit(None).cast("double").alias("share")
    )
    return by_column.unionByName(audits)


def score_bucket(score: Column) -> Column:
    return bands(score, [(80, "80-100"), (60, "60-80"), (40, "40-60"), (20, "20-40")], "0-20")


def dashboard_totals(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count(F.lit(1)).alias("total_sessions"), F.round(F.avg("quality_score"), 2).alias("avg_quality_score"))


def score_distribution(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(score_bucket(c("quality_score")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def top_issue_types(issues: DataFrame, k: int = 5) -> DataFrame:
    return issues.groupBy("issue_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "issue_type").limit(k)


def sessions_by_day(sessions: DataFrame, days: int = 7) -> DataFrame:
    """Sessions on each of the last ``days`` days that have any."""
    return sessions.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("day")).limit(days)


def batch_totals(results: DataFrame) -> DataFrame:
    ok = F.count(F.when(c("status") == "success", 1))
    return results.agg(F.count(F.lit(1)).alias("total"), ok.alias("succeeded"), (F.count(F.lit(1)) - ok).alias("failed"))


def store_counts(**tables: DataFrame) -> DataFrame:
    """(store, n) for the rule, decision and feedback tables."""
    out = None
    for name, table in tables.items():
        row = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("store"), "n")
        out = row if out is None else out.unionByName(row)
    return out
