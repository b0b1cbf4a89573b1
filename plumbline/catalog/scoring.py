"""Queries on scores, confidence and domains, over the issues of many datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.catalog.fixtures import (
    DAY_OF_USER, DETECTED_SQL, ISSUES_SQL, SEMANTIC_SQL, TOTALS_SQL, domain_values, domains, issues, per_day, semantic, sessions, SESSIONS_SQL, totals,
)
from plumbline.functions.expressions import severity_rank
from plumbline.operators import domains as D
from plumbline.operators import scoring as S

c = F.col


def weight(values: dict[str, int]) -> str:
    return "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " ELSE 0 END"


COLUMN_COST = weight({"critical": 40, "high": 25, "medium": 12, "low": 5})
DATASET_COST = weight({"low": 1, "medium": 3, "high": 7, "critical": 15})
DAY_ISSUES_SQL, DAY_TOTALS_SQL = per_day(ISSUES_SQL), per_day(TOTALS_SQL)
COLUMNS_SQL = f"SELECT DISTINCT dataset_id, \"column\" FROM ({per_day(SEMANTIC_SQL)})"
COLUMN_SCORES_SQL = f"""SELECT k.dataset_id, k."column", greatest(0.0, 100.0 - coalesce(cost, 0)) AS score FROM ({COLUMNS_SQL}) k
  LEFT JOIN (SELECT dataset_id, "column", sum({COLUMN_COST}) AS cost FROM ({DAY_ISSUES_SQL}) WHERE "column" IS NOT NULL GROUP BY ALL) i ON i.dataset_id = k.dataset_id AND i."column" = k."column" """
DATASET_SCORE_SQL = f"""SELECT *, round(greatest(0.0, 100 - null_penalty - issue_penalty), 1) AS score FROM (SELECT t.dataset_id, least(30.0, 100.0 * CAST(total_null_count AS DOUBLE) / (row_count * column_count)) AS null_penalty,
  least(50.0, CAST(coalesce(cost, 0) AS DOUBLE)) AS issue_penalty FROM ({DAY_TOTALS_SQL}) t LEFT JOIN (SELECT dataset_id, sum({DATASET_COST}) AS cost FROM ({DAY_ISSUES_SQL}) GROUP BY dataset_id) i USING (dataset_id))"""


@query(COLUMN_SCORES_SQL)
def column_scores(spark, folder):
    return S.column_scores(semantic(spark, folder, DAY_OF_USER).select("dataset_id", "column").distinct(), issues(spark, folder, DAY_OF_USER))


@query(f"SELECT dataset_id, round(null_penalty, 6) AS null_penalty, issue_penalty, score FROM ({DATASET_SCORE_SQL})")
def dataset_scores(spark, folder):
    return S.dataset_score(totals(spark, folder, DAY_OF_USER), issues(spark, folder, DAY_OF_USER)).withColumn("null_penalty", F.round("null_penalty", 6))


@query(f"SELECT CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS band, count(*) AS n FROM ({DATASET_SCORE_SQL}) GROUP BY 1")
def score_bands(spark, folder):
    return S.dataset_score(totals(spark, folder, DAY_OF_USER), issues(spark, folder, DAY_OF_USER)).groupBy(S.score_band(c("score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT severity, issue_type, count(*) AS n FROM ({ISSUES_SQL}) GROUP BY GROUPING SETS ((), (severity), (issue_type))")
def issue_counts(spark, folder):
    return S.issue_counts(issues(spark, folder))


ESCALATION_SQL = f"""SELECT dataset_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'critical' OR confidence < 0.7) AS doubtful, count(*) AS total FROM ({DAY_ISSUES_SQL}) GROUP BY dataset_id"""


@query(f"SELECT *, critical > 0 OR doubtful > 0.3 * total AS needs_escalation FROM ({ESCALATION_SQL})")
def escalation(spark, folder):
    return S.escalation(issues(spark, folder, DAY_OF_USER))


@query(f"""WITH s AS (SELECT dataset_id, avg(score) AS a FROM ({COLUMN_SCORES_SQL}) GROUP BY dataset_id), i AS (SELECT dataset_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity IN ('high', 'critical')) AS high_or_more FROM ({DAY_ISSUES_SQL}) GROUP BY dataset_id)
  SELECT dataset_id, round(a, 6) AS avg_score, critical, high_or_more, a >= 80 AND critical >= 2 AS score_vs_critical, high_or_more >= 2 AS plan_blind_spot FROM s JOIN i USING (dataset_id)""")
def coherence_flags(spark, folder):
    found = issues(spark, folder, DAY_OF_USER)
    scores = S.column_scores(semantic(spark, folder, DAY_OF_USER).select("dataset_id", "column").distinct(), found)
    return S.coherence(scores, found, outliers_checked=False).withColumn("avg_score", F.round("avg_score", 6))


SIZE = "CASE WHEN {n} <= 0 THEN 0.0 WHEN {n} < 10 THEN 0.2 WHEN {n} < 30 THEN 0.4 WHEN {n} < 100 THEN 0.6 WHEN {n} < 1000 THEN 0.8 ELSE 0.95 END"
LEVEL = "CASE WHEN {s} < 0.3 THEN 'very_low' WHEN {s} < 0.5 THEN 'low' WHEN {s} < 0.7 THEN 'medium' WHEN {s} < 0.9 THEN 'high' ELSE 'very_high' END"


def confidence_sql(quality: str, n: str, consistency: str, history: str = "0.5", coverage: str = "1.0") -> str:
    return (f"(0.25 * least(1.0, greatest(0.0, {quality})) + 0.20 * ({SIZE.format(n=n)}) + 0.25 * ({consistency}) + 0.15 * ({history}) + 0.15 * ({coverage}))")


AGREED = "CASE WHEN n = 1 THEN mean ELSE 0.6 * (1 - least(2 * std, 1.0)) + 0.4 * mean END"
SIGNALS = f"SELECT dataset_id, CAST(count(confidence) AS DOUBLE) AS n, avg(confidence) AS mean, stddev_pop(confidence) AS std FROM ({ISSUES_SQL}) GROUP BY dataset_id"


def scored_sql(score: str, source: str) -> str:
    return f"SELECT dataset_id, round(s, 7) AS score, {LEVEL.format(s='round(s, 9)')} AS level FROM (SELECT dataset_id, {score} AS s FROM ({source}))"


def rounded(rows):
    return rows.withColumn("score", F.round("score", 7))


@query(scored_sql(confidence_sql("1 - least(0.5, CAST(total_null_count AS DOUBLE) / (row_count * column_count))", "row_count", "1.0"), TOTALS_SQL))
def profile_confidence(spark, folder):
    return rounded(S.profile_confidence(totals(spark, folder)))


@query(scored_sql(confidence_sql("mean", "row_count", AGREED, coverage="0.8"), f"SELECT * FROM ({TOTALS_SQL}) JOIN ({SIGNALS}) USING (dataset_id)"))
def check_confidence(spark, folder):
    return rounded(S.check_confidence(issues(spark, folder), totals(spark, folder)))


@query(scored_sql(confidence_sql("mean", "n", AGREED, coverage="0.7"), SIGNALS))
def proposal_confidence(spark, folder):
    return rounded(S.proposal_confidence(issues(spark, folder)))


VALID = "SELECT dataset_id, CASE WHEN severity IN ('low', 'medium') THEN 0.9 ELSE 0.3 END AS signal, CASE WHEN severity IN ('low', 'medium') THEN 1.0 ELSE 0.0 END AS ok, CASE WHEN severity = 'medium' THEN 1 ELSE 0 END AS w FROM (" + DAY_ISSUES_SQL + ")"


@query(scored_sql(confidence_sql("ratio - least(0.2, 0.02 * w)", "n", AGREED, coverage="0.9"),
                  f"SELECT dataset_id, CAST(count(*) AS DOUBLE) AS n, avg(signal) AS mean, stddev_pop(signal) AS std, avg(ok) AS ratio, sum(w) AS w FROM ({VALID}) GROUP BY dataset_id"))
def validation_confidence(spark, folder):
    verdicts = issues(spark, folder, DAY_OF_USER).select("dataset_id", c("severity").isin("low", "medium").alias("is_valid"),
                                         F.when(c("severity") == "medium", F.array(F.lit("w"))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    return rounded(S.validation_confidence(verdicts))


QUALITY = "CASE WHEN affected_percentage < 1 THEN 0.4 WHEN affected_percentage < 5 THEN 0.6 WHEN affected_percentage < 20 THEN 0.8 ELSE 0.9 END"


@query(f"SELECT issue_id, round(s, 7) AS score, {LEVEL.format(s='round(s, 9)')} AS level, round(s, 9) < 0.5 AS needs_escalation FROM (SELECT issue_id, {confidence_sql(QUALITY, 'CAST(affected_count AS BIGINT) * 10', 'confidence')} AS s FROM ({ISSUES_SQL}))")
def issue_confidence(spark, folder):
    s = S.issue_confidence(c("affected_percentage"), c("confidence"), c("affected_count") * 10)
    return issues(spark, folder).select("issue_id", s.alias("s")).select("issue_id", F.round("s.score", 7).alias("score"), "s.level", "s.needs_escalation")


@query(f"""SELECT issue_id, round(s, 7) AS score FROM (SELECT issue_id, {confidence_sql('0.8 * confidence + 0.2 * impact', '100', '0.6 * (1 - least(abs(confidence - impact), 1.0)) + 0.2 * (confidence + impact)', '0.7', 'CASE WHEN total > 0 THEN CAST(done AS DOUBLE) / total ELSE 0.5 END')} AS s
  FROM (SELECT issue_id, confidence, affected_percentage / 40 AS impact, 3 AS done, CAST(affected_count AS BIGINT) % 5 * 3 AS total FROM ({ISSUES_SQL})))""")
def correction_confidence(spark, folder):
    s = S.correction_confidence(c("confidence"), c("affected_percentage") / 40, F.lit(3), c("affected_count") % 5 * 3, F.lit(0.7))
    return issues(spark, folder).select("issue_id", s.alias("s")).select("issue_id", F.round("s.score", 7).alias("score"))


@query(f"""SELECT dataset_id, session_id, round(s, 7) AS score FROM (SELECT dataset_id, session_id, (2 * quality_score / 100 + 1 * 0.6 + 1 * 0.5 + 0.5 * 0.5 + 0.5 * 1.0) / 5 AS s FROM ({SESSIONS_SQL}))""")
def confidence_with_own_weights(spark, folder):
    weights = {"data_quality": 2, "sample_size": 1, "signal_consistency": 1, "historical_accuracy": 0.5, "rule_coverage": 0.5}
    s = S.confidence_score(c("quality_score") / 100, F.lit(50), F.lit(0.5), weights=weights)
    return sessions(spark, folder).select("dataset_id", "session_id", F.round(s["score"], 7).alias("score"))


# Domains

@query(f"SELECT dataset_id, domain_id, round(ratio, 6) AS ratio FROM ({DETECTED_SQL})")
def detected_domains(spark, folder):
    return D.detect_domain(semantic(spark, folder), domains(spark)).withColumn("ratio", F.round("ratio", 6))


@query(f"""SELECT d.dataset_id, d.domain_id, r.required_type FROM ({DETECTED_SQL}) d JOIN ({domain_values(4)}) r(domain_id, required_type) USING (domain_id)
  WHERE NOT EXISTS (SELECT 1 FROM ({SEMANTIC_SQL}) s WHERE s.dataset_id = d.dataset_id AND s.semantic_type = r.required_type)""")
def missing_required_types(spark, folder):
    s = semantic(spark, folder)
    return D.missing_required_types(D.detect_domain(s, domains(spark)), s, domains(spark))


RANK = "CASE {x} WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 0 END"


@query(f"""WITH o AS (SELECT s.dataset_id, s."column", v.raised FROM ({DETECTED_SQL}) d JOIN ({domain_values(5)}) v(domain_id, semantic_type, raised) USING (domain_id) JOIN ({SEMANTIC_SQL}) s ON s.dataset_id = d.dataset_id AND s.semantic_type = v.semantic_type)
  SELECT i.dataset_id, issue_id, CASE WHEN {RANK.format(x='raised')} > {RANK.format(x='severity')} THEN raised ELSE severity END AS severity FROM ({ISSUES_SQL}) i LEFT JOIN o ON o.dataset_id = i.dataset_id AND o."column" = i."column" """)
def raised_severities(spark, folder):
    s = semantic(spark, folder)
    raised = D.raise_severity(issues(spark, folder).withColumn("needs_escalation", F.lit(False)), D.detect_domain(s, domains(spark)), s, domains(spark))
    return raised.select("dataset_id", "issue_id", "severity")


@query(f"""SELECT d.dataset_id, 'constraint_violation' AS issue_type, 'critical' AS severity, concat('required_type:', r.required_type) AS rule_id, t.row_count AS affected_count FROM ({DETECTED_SQL}) d JOIN ({domain_values(4)}) r(domain_id, required_type) USING (domain_id)
  JOIN ({TOTALS_SQL}) t USING (dataset_id) WHERE NOT EXISTS (SELECT 1 FROM ({SEMANTIC_SQL}) s WHERE s.dataset_id = d.dataset_id AND s.semantic_type = r.required_type)""")
def domain_issues(spark, folder):
    s = semantic(spark, folder)
    found = D.domain_issues(D.detect_domain(s, domains(spark)), s, domains(spark), totals(spark, folder))
    return found.select("dataset_id", "issue_type", "severity", "rule_id", "affected_count")


@query(f"SELECT severity, {RANK.format(x='severity')} AS rank, count(*) AS n FROM ({ISSUES_SQL}) GROUP BY ALL")
def severity_ranks(spark, folder):
    return issues(spark, folder).groupBy("severity", severity_rank(c("severity")).alias("rank")).agg(F.count(F.lit(1)).alias("n"))
