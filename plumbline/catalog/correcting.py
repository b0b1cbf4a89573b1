"""Queries on proposed, validated and applied corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.catalog.checking import MISSING_SQL, PSEUDO_SQL
from plumbline.catalog.fixtures import CUSTOMERS, CUSTOMERS_SQL, DAY_OF_USER, FEEDBACK_SQL, ISSUES_SQL, SESSIONS_SQL, USER, customers, feedback, issues, per_day, sessions, table, totals
from plumbline.catalog.profiling import number, over, pseudo, stripped, union
from plumbline.catalog.scoring import DATASET_SCORE_SQL, DAY_ISSUES_SQL
from plumbline.functions import constants as K
from plumbline.operators import checks as C
from plumbline.operators import corrections as R
from plumbline.operators import feedback as B
from plumbline.operators import scoring as S

c = F.col
NUMBERS = ["customer_id", "age", "taux_completion", "amount"]


def stat_sql(x: str) -> str:
    if x in NUMBERS:
        return (f"SELECT '{x}' AS \"column\", true AS is_numeric, round(avg({x}), 5) AS mean, round(quantile_cont(CAST({x} AS DOUBLE), 0.5), 5) AS median, "
                f"round(quantile_cont(CAST({x} AS DOUBLE), 0.01), 5) AS p1, round(quantile_cont(CAST({x} AS DOUBLE), 0.99), 5) AS p99, "
                f"(SELECT {x} FROM t WHERE {x} IS NOT NULL GROUP BY {x} ORDER BY count(*) DESC, {x} LIMIT 1)::VARCHAR AS mode FROM t")
    return (f"SELECT '{x}', false, NULL, NULL, NULL, NULL, (SELECT {x} FROM t WHERE {x} IS NOT NULL AND NOT ({pseudo(x)}) GROUP BY {x} ORDER BY count(*) DESC, {x} LIMIT 1)")


STATISTICS_SQL = union([stat_sql(x) for x in ("age", "amount", "email", "segment")])


@query(over(CUSTOMERS_SQL, "SELECT \"column\", is_numeric, mean, median, p1, p99, CASE WHEN is_numeric THEN NULL ELSE mode END AS mode FROM (" + STATISTICS_SQL + ")"))
def fill_statistics(spark, folder):
    rows = R.fill_statistics(customers(spark, folder), ["age", "amount", "email", "segment"])
    return rows.select("column", "is_numeric", *[F.round(x, 5).alias(x) for x in ("mean", "median", "p1", "p99")], F.when(~c("is_numeric"), c("mode")).alias("mode"))


# Statistics of the columns c0..c3 of every dataset, for proposals over many datasets.
STATS_SQL = "SELECT DISTINCT concat('user_', user_id) AS dataset_id, concat('c', event_id % 4) AS \"column\", event_id % 4 <> 2 AS is_numeric, CAST(user_id AS DOUBLE) AS median, CAST(user_id + 0.5 AS DOUBLE) AS mean, CAST(user_id - 10 AS DOUBLE) AS p1, CAST(user_id + 10 AS DOUBLE) AS p99, 'm' AS mode FROM events"


def statistics(spark, folder, dataset=USER):
    return table(spark, folder, "events").selectExpr(
        f"{dataset} AS dataset_id", "concat('c', event_id % 4) AS column", "event_id % 4 <> 2 AS is_numeric", "CAST(user_id AS DOUBLE) AS median",
        "CAST(user_id + 0.5 AS DOUBLE) AS mean", "CAST(user_id - 10 AS DOUBLE) AS p1", "CAST(user_id + 10 AS DOUBLE) AS p99", "'m' AS mode").distinct()


def proposal(kind: str, confidence: float, where: str, lower: str = "NULL", upper: str = "NULL", value: str = "NULL", target: str = '"column"') -> str:
    return (f"SELECT dataset_id, issue_id, issue_type, \"column\", '{kind}' AS correction_type, CAST(affected_count AS BIGINT) AS rows_affected, CAST({confidence} AS DOUBLE) AS confidence, "
            f"CAST({lower} AS DOUBLE) AS lower, CAST({upper} AS DOUBLE) AS upper, CAST({value} AS VARCHAR) AS value, {target} AS target FROM j WHERE {where}")


PROPOSALS_SQL = f"""WITH j AS (SELECT i.*, s.is_numeric, s.median, s.mean, s.p1, s.p99, s.mode, s.dataset_id IS NOT NULL AS known FROM ({ISSUES_SQL}) i LEFT JOIN ({STATS_SQL}) s ON s.dataset_id = i.dataset_id AND s."column" = i."column")
  """ + union([
    proposal("impute_median", 0.8, "issue_type = 'missing_values' AND known AND is_numeric", value="median"),
    proposal("impute_mean", 0.7, "issue_type = 'missing_values' AND known AND is_numeric", value="mean"),
    proposal("impute_mode", 0.7, "issue_type = 'missing_values' AND known AND NOT is_numeric", value="mode"),
    proposal("delete_row", 0.85, "issue_type = 'missing_values' AND known AND affected_percentage < 5"),
    proposal("clip_values", 0.75, "issue_type = 'anomaly' AND known", lower="p1", upper="p99"),
    proposal("flag_only", 0.9, "issue_type = 'anomaly' AND known"),
    proposal("cast_type", 0.8, "issue_type = 'type_mismatch'"),
    proposal("delete_row", 0.85, "issue_type = 'constraint_violation' AND kind = 'duplicate'"),
    proposal("manual_review", 0.95, "issue_type = 'constraint_violation'", target="NULL"),
    proposal("manual_review", 0.5, "issue_type = 'format_error'", target="NULL"),
])


def proposals(spark, folder, dataset=USER):
    return R.propose(issues(spark, folder, dataset), statistics(spark, folder, dataset))


def flat(rows):
    of = lambda k: F.element_at("parameters", k)
    return rows.select("dataset_id", "issue_id", "issue_type", "column", "correction_type", "rows_affected", "confidence",
                       of("lower").cast("double").alias("lower"), of("upper").cast("double").alias("upper"), of("value").alias("value"), of("column").alias("target"))


@query(f"SELECT dataset_id, issue_id, issue_type, \"column\", correction_type, rows_affected, confidence, lower, upper, value, target FROM ({PROPOSALS_SQL})")
def proposed_corrections(spark, folder):
    return flat(proposals(spark, folder))


LEARNED_SQL = f"SELECT correction_type, round((count(*) FILTER (WHERE is_correct) / CAST(count(is_correct) AS DOUBLE) - 0.5) * 0.3, 3) AS adjustment FROM ({FEEDBACK_SQL}) GROUP BY correction_type"


@query(f"SELECT issue_id, p.correction_type, round(CASE WHEN adjustment IS NULL THEN confidence ELSE greatest(0.1, least(1.0, confidence + adjustment)) END, 5) AS confidence FROM ({PROPOSALS_SQL}) p LEFT JOIN ({LEARNED_SQL}) l ON l.correction_type = p.correction_type")
def corrections_adjusted_by_feedback(spark, folder):
    rows = R.adjust_from_feedback(proposals(spark, folder), B.learn(feedback(spark, folder), "correction_type"))
    return rows.select("issue_id", "correction_type", F.round("confidence", 5).alias("confidence"))


# Datasets of different sizes, so that some deletions leave too little.
SIZES_SQL = "SELECT concat('user_', user_id) AS dataset_id, count(*) AS row_count FROM events GROUP BY user_id"
RULE_ROWS = [("c0", "r_null", "values are never null"), ("c1", "r_positive", "amounts are positive"), ("c3", "r_unique", "the id is unique")]
_RULES = "VALUES " + ", ".join(f"('{a}', '{b}', '{t}')" for a, b, t in RULE_ROWS)
CHANGED_SQL = "VALUES ('c0', 3), ('c1', 60), ('c3', 20)"
VERDICT_SQL = f"""WITH p AS (SELECT p.*, s.row_count AS total, x.is_numeric IS NOT NULL AS found, coalesce(x.is_numeric, false) AS is_number, ch.changed, r.rule_id, r.text FROM ({PROPOSALS_SQL}) p JOIN ({SIZES_SQL}) s USING (dataset_id)
    LEFT JOIN (SELECT DISTINCT dataset_id, "column", is_numeric FROM ({STATS_SQL})) x ON x.dataset_id = p.dataset_id AND x."column" = p.target LEFT JOIN ({CHANGED_SQL}) ch(col, changed) ON ch.col = p.target
    LEFT JOIN ({_RULES}) r(col, rule_id, text) ON r.col = p.target),
  v AS (SELECT *, (CASE WHEN target IS NOT NULL AND NOT found THEN 1 ELSE 0 END) + (CASE WHEN correction_type = 'clip_values' AND found AND lower >= upper THEN 1 ELSE 0 END) + (CASE WHEN correction_type = 'delete_row' AND found AND total - rows_affected < 10 THEN 1 ELSE 0 END) AS reasons,
    (CASE WHEN (found OR target IS NULL) AND rows_affected > 0.5 * total THEN 1 ELSE 0 END) + (CASE WHEN correction_type = 'delete_row' AND found AND total - rows_affected >= 10 AND total - rows_affected < 0.1 * total THEN 1 ELSE 0 END)
    + (CASE WHEN correction_type IN ('impute_mean', 'impute_median') AND found AND is_number AND rows_affected > 0.3 * total THEN 1 ELSE 0 END) + (CASE WHEN correction_type = 'clip_values' AND found AND is_number AND changed > 1.5 * rows_affected THEN 1 ELSE 0 END) + (CASE WHEN confidence < 0.5 THEN 1 ELSE 0 END) AS warnings,
    CASE WHEN rule_id IS NULL THEN 0 ELSE 1 END AS checked, CASE WHEN (contains(text, 'null') AND correction_type = 'delete_row' AND rows_affected > 0.3 * total) OR (contains(text, 'positive') AND correction_type = 'clip_values' AND lower < 0) THEN 1 ELSE 0 END AS failed FROM p)
  SELECT issue_id, correction_type, reasons = 0 AND failed = 0 AS is_valid, CASE WHEN reasons > 0 OR failed > 0 THEN 'rejected' WHEN warnings > 0 THEN 'approved_with_warnings' ELSE 'approved' END AS status, CAST(reasons AS INT) AS reasons, CAST(warnings AS INT) AS warnings, CAST(checked AS INT) AS rules_checked, CAST(failed AS INT) AS rules_failed FROM v"""


def validations(spark, folder):
    p = proposals(spark, folder)
    sizes = table(spark, folder, "events").groupBy(F.concat(F.lit("user_"), "user_id").alias("dataset_id")).agg(F.count(F.lit(1)).alias("row_count"))
    matches = spark.createDataFrame(RULE_ROWS, "column string, rule_id string, text string")
    changed = spark.createDataFrame([("c0", 3), ("c1", 60), ("c3", 20)], "column string, changed bigint")
    return p, R.validate(p, statistics(spark, folder).select("dataset_id", "column", "is_numeric"), sizes, matches, changed)


@query(VERDICT_SQL)
def validated_corrections(spark, folder):
    p, v = validations(spark, folder)
    return p.select("proposal_id", "issue_id", "correction_type").join(v, "proposal_id").select(
        "issue_id", "correction_type", "is_valid", "status", *[F.size(x).alias(x) for x in ("reasons", "warnings", "rules_checked", "rules_failed")])


@query(f"SELECT status, count(*) AS n FROM ({VERDICT_SQL}) GROUP BY status")
def validation_summary(spark, folder):
    return R.validation_summary(validations(spark, folder)[1])


@query(f"SELECT correction_type, count(*) AS n FROM ({PROPOSALS_SQL}) GROUP BY correction_type")
def proposal_summary(spark, folder):
    return R.proposal_summary(proposals(spark, folder))


@query(f"SELECT issue_id, correction_type, is_valid AS is_approved, CASE WHEN is_valid THEN 'validator' END AS approved_by FROM ({VERDICT_SQL})")
def approvals(spark, folder):
    return R.approve(*validations(spark, folder)).select("issue_id", "correction_type", "is_approved", "approved_by")


ACTION = "CASE issue_type " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in K.CORRECTION_ACTIONS.items()) + " ELSE 'manual_review' END"
AUTO = "issue_type IN (" + ", ".join(f"'{k}'" for k, v in K.CORRECTION_ACTIONS.items() if v[1]) + ")"


@query(f"SELECT issue_id, severity, {ACTION} AS recommended_action, {AUTO} AS auto_applicable FROM ({ISSUES_SQL})")
def correction_plan(spark, folder):
    return R.correction_plan(issues(spark, folder)).select("issue_id", "severity", "recommended_action", "auto_applicable")


@query(f"""SELECT s.dataset_id, s.score, coalesce(auto, 0) AS auto, coalesce(manual, 0) AS manual, least(100.0, s.score + coalesce(gain, 0)) AS estimated_score FROM ({DATASET_SCORE_SQL}) s LEFT JOIN (
  SELECT dataset_id, count(*) FILTER (WHERE {AUTO}) AS auto, count(*) FILTER (WHERE NOT {AUTO}) AS manual, sum(CASE WHEN {AUTO} THEN CASE severity WHEN 'critical' THEN 15 WHEN 'high' THEN 10 WHEN 'medium' THEN 5 ELSE 2 END ELSE 0 END) AS gain FROM ({DAY_ISSUES_SQL}) GROUP BY dataset_id) p USING (dataset_id)""")
def estimated_scores(spark, folder):
    found = issues(spark, folder, DAY_OF_USER)
    return R.estimated_score(R.correction_plan(found), S.dataset_score(totals(spark, folder, DAY_OF_USER), found).select("dataset_id", "score"))


@query(f"SELECT s.dataset_id, round(least(100 - s.score, 5.0 * coalesce(n, 0)), 1) AS estimated_improvement FROM ({DATASET_SCORE_SQL}) s LEFT JOIN (SELECT dataset_id, count(*) AS n FROM ({per_day(PROPOSALS_SQL)}) GROUP BY dataset_id) p USING (dataset_id)")
def estimated_improvement(spark, folder):
    return R.estimated_improvement(proposals(spark, folder, DAY_OF_USER), S.dataset_score(totals(spark, folder, DAY_OF_USER), issues(spark, folder, DAY_OF_USER)).select("dataset_id", "score"))


# Applying

COPIES_SQL = "SELECT l_suppkey, l_linenumber, l_returnflag, l_linestatus, l_discount FROM lineitem"


@query(f"SELECT DISTINCT * FROM ({COPIES_SQL})")
def drop_duplicate_rows(spark, folder):
    df = table(spark, folder, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount")
    return R.apply(df, R.CorrectionPlan(drop_duplicates=True))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders) WHERE place = 1")
def drop_duplicate_keys(spark, folder):
    df = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return R.drop_duplicate_keys(df, ["o_custkey"], ["o_orderkey"])


def mode_sql(x: str) -> str:
    return f"(SELECT {x} FROM t WHERE {x} IS NOT NULL AND NOT ({pseudo(x)}) GROUP BY {x} ORDER BY count(*) DESC, {x} LIMIT 1)"


@query(over(CUSTOMERS_SQL, f"SELECT row_key, round(coalesce(CAST(age AS DOUBLE), (SELECT quantile_cont(CAST(age AS DOUBLE), 0.5) FROM t)), 5) AS age, "
                           f"coalesce(CASE WHEN {pseudo('segment')} THEN NULL ELSE segment END, {mode_sql('segment')}) AS segment FROM t"))
def impute_median_and_mode(spark, folder):
    out = R.apply(customers(spark, folder), R.CorrectionPlan(unmask=["segment"], impute={"age": "median", "segment": "mode"}))
    return out.select("row_key", F.round("age", 5).alias("age"), "segment")


@query(over(CUSTOMERS_SQL, f"SELECT row_key, {stripped('email')} AS email FROM t"))
def trim_text(spark, folder):
    return R.apply(customers(spark, folder), R.CorrectionPlan(trim=["email"])).select("row_key", "email")


@query(over(CUSTOMERS_SQL, f"SELECT row_key, {number('siret')} AS siret, code FROM t"))
def cast_numeric_text(spark, folder):
    """siret is all numbers and is cast; code is a third numbers and stays text."""
    return R.apply(customers(spark, folder), R.CorrectionPlan(cast=["siret", "code"], cast_threshold=0.9)).select("row_key", "siret", "code")


@query(over(CUSTOMERS_SQL, """SELECT row_key, least(120.0, greatest(0.0, CAST(age AS DOUBLE))) AS age, round((taux_completion - (SELECT avg(taux_completion) FROM t)) / (SELECT stddev_samp(taux_completion) FROM t), 5) AS taux_completion,
  amount < 0 AS amount_is_anomaly, coalesce(full_name, 'unknown') AS full_name FROM t WHERE NOT coalesce(code = '1d', false)""").replace("(SELECT avg(taux_completion) FROM t)", "(SELECT avg(taux_completion) FROM t WHERE code <> '1d')").replace("(SELECT stddev_samp(taux_completion) FROM t)", "(SELECT stddev_samp(taux_completion) FROM t WHERE code <> '1d')")
       .replace("least(120.0, greatest(0.0, CAST(age AS DOUBLE))) AS age", "CASE WHEN age IS NOT NULL THEN least(120.0, greatest(0.0, CAST(age AS DOUBLE))) END AS age"))
def other_corrections(spark, folder):
    """Delete rows, drop a column, clip, standardise, flag, and fill with a given value."""
    plan = R.CorrectionPlan(drop_rows=c("code") == "1d", drop_columns=["note"], clip={"age": (0.0, 120.0)}, standardize=["taux_completion"],
                            flag={"amount_is_anomaly": c("amount") < 0}, impute={"full_name": "unknown"})
    out = R.apply(customers(spark, folder), plan)
    return out.select("row_key", "age", F.round("taux_completion", 5).alias("taux_completion"), "amount_is_anomaly", "full_name")


@query(over(CUSTOMERS_SQL, """SELECT row_key, round(CASE WHEN amount IS NOT NULL THEN greatest(lo, least(hi, amount)) END, 5) AS amount, round(coalesce(CAST(age AS DOUBLE), (SELECT avg(age) FROM t)), 5) AS age
  FROM t, (SELECT quantile_cont(amount, 0.01) AS lo, quantile_cont(amount, 0.99) AS hi FROM t)"""))
def clip_to_percentiles_and_impute_mean(spark, folder):
    out = R.apply(customers(spark, folder), R.CorrectionPlan(clip_to_percentiles=["amount"], impute={"age": "mean"}))
    return out.select("row_key", F.round("amount", 5).alias("amount"), F.round("age", 5).alias("age"))


@query(over(CUSTOMERS_SQL, "SELECT 'age' AS \"column\", count(*) FILTER (WHERE age < 0 OR age > 80) AS changed FROM t UNION ALL SELECT 'amount', count(*) FILTER (WHERE amount < 0 OR amount > 5000) FROM t"))
def clip_counts(spark, folder):
    asked = spark.createDataFrame([("age", "clip_values", {"lower": "0", "upper": "80"}), ("amount", "clip_values", {"lower": "0", "upper": "5000"})], "column string, correction_type string, parameters map<string,string>")
    return R.clip_counts(customers(spark, folder), asked, ["age", "amount"])


@query(f"""WITH a AS (SELECT DISTINCT * FROM ({COPIES_SQL})) SELECT (SELECT count(*) FROM lineitem) AS rows_before, (SELECT count(*) FROM a) AS rows_after, CAST(1 AS INT) AS corrections""")
def apply_report(spark, folder):
    df = table(spark, folder, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount")
    return R.apply_report(df, R.apply(df, R.CorrectionPlan(drop_duplicates=True)), 1)


# Comparing

CHECKED = ["missing_values", "pseudo_nulls"]
_AFTER = f"SELECT * REPLACE (coalesce(age, 1) AS age, coalesce(full_name, 'x') AS full_name) FROM ({CUSTOMERS_SQL})"


def both_sides(body: str) -> str:
    cost = "CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 25 WHEN 'medium' THEN 12 WHEN 'low' THEN 5 ELSE 0 END"
    found = union([MISSING_SQL, PSEUDO_SQL])
    names = "VALUES " + ", ".join(f"('{x}')" for x in CUSTOMERS)

    def scores(issues_sql: str) -> str:
        return f"SELECT k.name AS \"column\", greatest(0.0, 100.0 - coalesce(sum({cost}), 0)) AS score FROM ({names}) k(name) LEFT JOIN ({issues_sql}) i ON i.\"column\" = k.name GROUP BY k.name"

    return f"WITH ib AS ({over(CUSTOMERS_SQL, found)}), ia AS ({over(_AFTER, found)}), b AS ({scores('SELECT * FROM ib')}), a AS ({scores('SELECT * FROM ia')}) {body}"


def before_and_after(spark, folder):
    df = customers(spark, folder)
    after = R.apply(df, R.CorrectionPlan(impute={"age": "1", "full_name": "x"}))
    return df, C.column_issues(df, CHECKED), after, C.column_issues(after, CHECKED)


@query(both_sides("SELECT b.\"column\", b.score AS before, a.score AS after FROM b JOIN a ON a.\"column\" = b.\"column\" WHERE a.score > b.score"))
def improved_columns(spark, folder):
    df, b, _, a = before_and_after(spark, folder)
    names = spark.createDataFrame([("table", x) for x in df.columns], "dataset_id string, column string")
    return R.improved_columns(S.column_scores(names, b), S.column_scores(names, a))


@query(both_sides("SELECT issue_type, CASE WHEN issue_type IN (SELECT issue_type FROM ia) THEN 'remaining' ELSE 'removed' END AS status FROM (SELECT DISTINCT issue_type FROM ib)"))
def issue_type_changes(spark, folder):
    _, b, _, a = before_and_after(spark, folder)
    return R.issue_type_changes(b, a)


@query(f"""WITH s AS (SELECT dataset_id, min(quality_score) AS b, max(quality_score) AS a FROM ({SESSIONS_SQL}) GROUP BY dataset_id) SELECT dataset_id, b AS score_before, a AS score_after, round(a - b, 2) AS delta FROM s""")
def score_comparison(spark, folder):
    rows = sessions(spark, folder).groupBy("dataset_id")
    return R.comparison(rows.agg(F.min("quality_score").alias("score")), rows.agg(F.max("quality_score").alias("score")))
