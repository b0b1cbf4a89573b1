"""Scores, counts, escalation and confidence over issue tables of any number of datasets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import constants as K
from plumbline.functions.expressions import bands, count_where, lookup

c = F.col
SCORE_BANDS = [(90, "excellent"), (70, "good"), (50, "fair")]


def score_band(score: Column) -> Column:
    return bands(score, SCORE_BANDS, "poor")


def column_scores(columns: DataFrame, issues: DataFrame) -> DataFrame:
    """(dataset_id, column, score): 100 less the deductions of its issues, not below 0."""
    cost = issues.where(c("column").isNotNull()).groupBy("dataset_id", "column").agg(
        F.sum(lookup(c("severity"), K.COLUMN_DEDUCTION, 0)).alias("cost")
    )
    return columns.select("dataset_id", "column").join(cost, ["dataset_id", "column"], "left").select(
        "dataset_id", "column", F.greatest(F.lit(0.0), 100.0 - F.coalesce("cost", F.lit(0))).alias("score")
    )


def dataset_score(totals: DataFrame, issues: DataFrame) -> DataFrame:
    """(dataset_id, null_penalty, issue_penalty, score) from table totals and issues."""
    cost = issues.groupBy("dataset_id").agg(F.sum(lookup(c("severity"), K.DATASET_DEDUCTION, 1)).alias("cost"))
    cells = c("row_count") * c("column_count")
    nulls = F.least(F.lit(30.0), 100.0 * c("total_null_count") / cells)
    found = F.least(F.lit(50.0), F.coalesce("cost", F.lit(0)).cast("double"))
    empty = F.coalesce(cells, F.lit(0)) == 0
    return totals.join(cost, "dataset_id", "left").select(
        "dataset_id",
        F.when(empty, 0.0).otherwise(nulls).alias("null_penalty"),
        F.when(empty, 0.0).otherwise(found).alias("issue_penalty"),
    ).select("*", F.round(F.greatest(F.lit(0.0), 100.0 - c("null_penalty") - c("issue_penalty")), 1).alias("score"))


def issue_counts(issues: DataFrame) -> DataFrame:
    """Issues in total, by severity and by type, in one pass: (severity, issue_type, n)."""
    return issues.groupingSets([[], ["severity"], ["issue_type"]], "severity", "issue_type").agg(F.count(F.lit(1)).alias("n"))


def escalation(issues: DataFrame, proposals: DataFrame | None = None, confidence_threshold: float = 0.7) -> DataFrame:
    """(dataset_id, critical, doubtful, total, ..., needs_escalation)."""
    found = issues.groupBy("dataset_id").agg(
        count_where(c("severity") == "critical").alias("critical"),
        count_where((c("severity") == "critical") | (c("confidence") < confidence_threshold)).alias("doubtful"),
        F.count(F.lit(1)).alias("total"),
    )
    needs = (c("critical") > 0) | (c("doubtful") > 0.3 * c("total"))
    if proposals is None:
        return found.select("*", needs.alias("needs_escalation"))
    weak = proposals.groupBy("dataset_id").agg(
        count_where(c("confidence") < confidence_threshold).alias("weak_proposals"), F.count(F.lit(1)).alias("proposals")
    )
    joined = found.join(weak, "dataset_id", "left").fillna(0, ["weak_proposals", "proposals"])
    return joined.select("*", (needs | (c("weak_proposals") > 0.5 * c("proposals"))).alias("needs_escalation"))


def coherence(scores: DataFrame, issues: DataFrame, outliers_checked: bool = True) -> DataFrame:
    """Flags where column scores and severities disagree, per dataset."""
    avg = scores.groupBy("dataset_id").agg(F.avg("score").alias("avg_score"))
    found = issues.groupBy("dataset_id").agg(
        count_where(c("severity") == "critical").alias("critical"),
        count_where(c("severity").isin("high", "critical")).alias("high_or_more"),
    )
    blind = (c("high_or_more") >= 2) if not outliers_checked else F.lit(False)
    return avg.join(found, "dataset_id").select(
        "dataset_id", "avg_score", "critical", "high_or_more",
        ((c("avg_score") >= 80.0) & (c("critical") >= 2)).alias("score_vs_critical"), blind.alias("plan_blind_spot"),
    )


# Confidence

def sample_size_factor(n: Column) -> Column:
    return F.when(n <= 0, 0.0).otherwise(
        F.when(n < 10, 0.2).when(n < 30, 0.4).when(n < 100, 0.6).when(n < 1000, 0.8).otherwise(0.95)
    )


def consistency_factor(count: Column, mean: Column, std: Column) -> Column:
    """Agreement of signals, from their count, mean and population deviation."""
    agreed = 0.6 * (1.0 - F.least(2.0 * std, F.lit(1.0))) + 0.4 * mean
    return F.when(F.coalesce(count, F.lit(0)) == 0, 0.5).when(count == 1, mean).otherwise(agreed)


def _unit(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def confidence_score(data_quality: Column, sample_size: Column, consistency: Column,
                     historical_accuracy: Column | None = None, rule_coverage: Column | float = 1.0,
                     weights: Mapping[str, float] | None = None, escalation_threshold: float = 0.5) -> Column:
    """Struct (score, level, needs_escalation, factors) of five weighted factors."""
    weights = dict(weights or K.CONFIDENCE_WEIGHTS)
    total = sum(weights.values())
    history = F.lit(None).cast("double") if historical_accuracy is None else historical_accuracy
    coverage = rule_coverage if isinstance(rule_coverage, Column) else F.lit(rule_coverage)
    factors = {
        "data_quality": _unit(data_quality), "sample_size": sample_size_factor(sample_size),
        "signal_consistency": consistency, "historical_accuracy": F.when(history.isNull(), 0.5).otherwise(_unit(history)),
        "rule_coverage": _unit(coverage),
    }
    score = sum((f * (weights[k] / total) for k, f in factors.items()), F.lit(0.0))
    level = bands(score, [(0.9, "very_high"), (0.7, "high"), (0.5, "medium"), (0.3, "low")], "very_low")
    return F.struct(
        score.alias("score"), level.alias("level"), (score < escalation_threshold).alias("needs_escalation"),
        F.create_map(*[x for k, f in factors.items() for x in (F.lit(k), f)]).alias("factors"),
    )


def issue_confidence(affected_percentage: Column, strength: Column, sample_size: Column, accuracy: Column | None = None) -> Column:
    quality = F.when(affected_percentage < 1, 0.4).when(affected_percentage < 5, 0.6).when(affected_percentage < 20, 0.8).otherwise(0.9)
    return confidence_score(quality, sample_size, strength, accuracy)


def correction_confidence(issue_confidence: Column, impact: Column, validated: Column, total: Column, success: Column | None = None) -> Column:
    mean = (issue_confidence + impact) / 2.0
    std = F.abs(issue_confidence - impact) / 2.0
    coverage = F.when(total > 0, validated / total).otherwise(0.5)
    return confidence_score(
        0.8 * issue_confidence + 0.2 * impact, F.lit(100), consistency_factor(F.lit(2), mean, std), success, coverage
    )


def profile_confidence(totals: DataFrame) -> DataFrame:
    """Confidence of a profile, less sure the more cells are null."""
    cells = c("row_count") * c("column_count")
    nulls = F.when(cells > 0, c("total_null_count") / cells).otherwise(0.0)
    score = confidence_score(1.0 - F.least(nulls, F.lit(0.5)), c("row_count"), F.lit(1.0))
    return totals.select("dataset_id", score.alias("_s")).select("dataset_id", "_s.score", "_s.level")


def check_confidence(issues: DataFrame, totals: DataFrame) -> DataFrame:
    """Confidence of the checks of a dataset: how sure and how alike its issues are."""
    signals = issues.groupBy("dataset_id").agg(
        F.count("confidence").alias("n"), F.avg("confidence").alias("mean"), F.stddev_pop("confidence").alias("std")
    )
    mean = F.coalesce("mean", F.lit(0.9))
    consistency = F.when(c("n").isNull(), 0.9).otherwise(consistency_factor(c("n"), c("mean"), c("std")))
    score = confidence_score(mean, c("row_count"), consistency, rule_coverage=0.8)
    joined = totals.join(signals, "dataset_id", "left")
    return joined.select("dataset_id", score.alias("_s")).select("dataset_id", "_s.score", "_s.level")


def proposal_confidence(proposals: DataFrame) -> DataFrame:
    signals = proposals.groupBy("dataset_id").agg(
        F.count("confidence").alias("n"), F.avg("confidence").alias("mean"), F.stddev_pop("confidence").alias("std")
    )
    score = confidence_score(c("mean"), c("n"), consistency_factor(c("n"), c("mean"), c("std")), rule_coverage=0.7)
    return signals.select("dataset_id", score.alias("_s")).select("dataset_id", "_s.score", "_s.level")


def validation_confidence(validations: DataFrame) -> DataFrame:
    """From the share of approvals, less 0.02 per warning (0.2 at most)."""
    signal = F.when(c("is_valid"), 0.9).otherwise(0.3)
    rows = validations.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(signal).alias("mean"), F.stddev_pop(signal).alias("std"),
        F.avg(c("is_valid").cast("double")).alias("ratio"), F.sum(F.size("warnings")).alias("warnings"),
    )
    quality = c("ratio") - F.least(F.lit(0.2), 0.02 * c("warnings"))
    score = confidence_score(quality, c("n"), consistency_factor(c("n"), c("mean"), c("std")), rule_coverage=0.9)
    return rows.select("dataset_id", score.alias("_s")).select("dataset_id", "_s.score", "_s.level")
