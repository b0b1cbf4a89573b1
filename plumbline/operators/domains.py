"""Business domains: which profile fits a table, what it requires, which severities it raises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import stronger
from plumbline.operators.checks import details, finish, issue

c = F.col


def detect_domain(semantic: DataFrame, profiles: DataFrame) -> DataFrame:
    """(dataset_id, domain_id, ratio): the active profile with the largest share of its triggers present.

    A profile must reach its own minimum; equal shares go to the one created first.
    """
    live = profiles.where(F.coalesce("active", F.lit(True)) & (F.size(F.array_distinct("trigger_types")) > 0))
    triggers = live.select(
        "domain_id", "created_at", "min_match_ratio", F.size(F.array_distinct("trigger_types")).alias("wanted"),
        F.explode(F.array_distinct("trigger_types")).alias("semantic_type"),
    )
    present = semantic.select("dataset_id", "semantic_type").distinct()
    shares = present.join(triggers, "semantic_type").groupBy("dataset_id", "domain_id", "created_at", "min_match_ratio", "wanted").agg(
        (F.count(F.lit(1)) / c("wanted")).alias("ratio")
    ).where((c("ratio") >= c("min_match_ratio")) & (c("ratio") > 0))
    best = F.min_by(F.struct("domain_id", "ratio"), F.struct((-c("ratio")).alias("r"), c("created_at"), c("domain_id")))
    return shares.groupBy("dataset_id").agg(best.alias("b")).select("dataset_id", "b.domain_id", "b.ratio")


def missing_required_types(detected: DataFrame, semantic: DataFrame, profiles: DataFrame) -> DataFrame:
    """(dataset_id, domain_id, required_type) that no column of the dataset has."""
    required = detected.join(profiles.select("domain_id", F.explode("required_types").alias("semantic_type")), "domain_id")
    present = semantic.select("dataset_id", "semantic_type").distinct()
    return required.join(present, ["dataset_id", "semantic_type"], "left_anti").select(
        "dataset_id", "domain_id", c("semantic_type").alias("required_type")
    )


def raise_severity(issues: DataFrame, detected: DataFrame, semantic: DataFrame, profiles: DataFrame) -> DataFrame:
    """Issues with the severity of their column's type raised (never lowered) by the domain."""
    overrides = detected.join(profiles.select("domain_id", F.explode("severity_overrides").alias("semantic_type", "raised")), "domain_id")
    by_column = semantic.join(overrides, ["dataset_id", "semantic_type"]).select("dataset_id", c("column").alias("_column"), F.lower("raised").alias("_raised"))
    # issues without a column get a key of their own: nulls would all meet in one task
    rows = issues.withColumn("_column", F.coalesce("column", F.concat(F.lit("\0"), "issue_id"))).join(by_column, ["dataset_id", "_column"], "left")
    severity = stronger(c("severity"), c("_raised"))
    out = rows.withColumn("severity", severity).withColumn(
        "needs_escalation", (c("severity") == "critical") | (c("confidence") < 0.7)
    )
    return out.select(*issues.columns)


def domain_issues(detected: DataFrame, semantic: DataFrame, profiles: DataFrame, totals: DataFrame) -> DataFrame:
    """One critical issue per required type that is missing."""
    rows = missing_required_types(detected, semantic, profiles).join(totals.select("dataset_id", "row_count"), "dataset_id")
    words = F.concat(F.lit("Domain '"), c("domain_id"), F.lit("' requires a column of type '"), c("required_type"), F.lit("'"))
    found = issue(
        F.concat(F.lit("required_type:"), c("required_type")), "constraint_violation", "critical", c("row_count"), F.lit(100.0), 0.99,
        words, details(domain_id=c("domain_id"), required_type=c("required_type")),
    )
    return finish(rows.select("dataset_id", F.lit(None).cast("string").alias("column"), found.alias("i")).select("dataset_id", "column", "i.*"))


def domain_rules(detected: DataFrame, profiles: DataFrame) -> DataFrame:
    """(dataset_id, domain_id, rule_text) of the detected domains."""
    return detected.join(profiles.select("domain_id", F.explode("rules").alias("rule_text")), "domain_id").select(
        "dataset_id", "domain_id", "rule_text"
    )


