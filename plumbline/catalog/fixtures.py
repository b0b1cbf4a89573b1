"""Tables the queries run on: the sample tables, and ones derived from them row by row.

The sample tables are clean, so defects are planted by expressions that both Spark and DuckDB read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_sql(columns: dict[str, str], source: str) -> str:
    fields = ", ".join(f'{e} AS "{n}"' for n, e in columns.items())
    return f"SELECT {fields} FROM {source}"


def derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in columns.items()])


K = "c_custkey"
CUSTOMERS = {
    "row_key": K,
    "customer_id": f"{K} - CASE WHEN {K} % 50 = 49 THEN 1 ELSE 0 END",
    "full_name": f"CASE WHEN {K} % 20 = 3 THEN NULL ELSE c_name END",
    "email": f"CASE WHEN {K} % 10 = 1 THEN 'N/A' WHEN {K} % 10 = 2 THEN 'not-an-email' WHEN {K} % 25 = 4 THEN NULL "
             f"WHEN {K} % 10 = 5 THEN concat(' user', {K}, '@example.com ') ELSE concat('user', {K}, '@example.com') END",
    "phone": f"CASE WHEN {K} % 4 = 0 THEN '12345' ELSE concat('06123456', 10 + {K} % 90) END",
    "code_postal": f"CASE WHEN {K} % 8 = 0 THEN 'abc' ELSE concat('', 10000 + {K} % 80000) END",
    "siret": f"CASE WHEN {K} % 3 = 0 THEN '123' ELSE concat('', 10000000000000 + {K}) END",
    "age": f"CAST(CASE WHEN {K} % 40 = 7 THEN 200 WHEN {K} % 40 = 8 THEN -5 WHEN {K} % 12 = 5 THEN NULL ELSE {K} % 90 END AS INT)",
    "taux_completion": f"CAST(CASE WHEN {K} % 30 = 1 THEN 150 ELSE {K} % 100 END AS DOUBLE)",
    "amount": f"CASE WHEN {K} % 33 = 0 THEN -1 - abs(c_acctbal) ELSE abs(c_acctbal) END",
    "code": f"CASE WHEN {K} % 3 = 0 THEN concat('', {K}) WHEN {K} % 3 = 1 THEN '1d' ELSE 'ref-x' END",
    "segment": f"CASE WHEN {K} % 6 = 0 THEN ' Unknown' WHEN {K} % 9 = 1 THEN 'nd' ELSE c_mktsegment END",
    "signup": f"CASE WHEN {K} % 9 = 0 THEN '2024-13-45' WHEN {K} % 7 = 0 THEN '31/12/2023' ELSE concat('2024-0', 1 + {K} % 9, '-1', {K} % 8) END",
    "is_active": f"CASE WHEN {K} % 2 = 0 THEN 'Yes' ELSE 'no' END",
    "note": f"CASE WHEN {K} % 15 = 0 THEN '' WHEN {K} % 15 = 1 THEN '   ' ELSE concat('customer of segment ', c_mktsegment, ' with a long enough remark, number ', {K}) END",
}
CUSTOMERS_SQL = as_sql(CUSTOMERS, "customer")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with planted defects of every kind."""
    return derive(table(spark, folder, "customer"), CUSTOMERS)


USER = "concat('user_', user_id)"
DAY_OF_USER = "concat('user_', user_id, '_', CAST(ts AS DATE))"


def per_day(sql: str) -> str:
    """The SQL with a dataset for each day of a user: two or three issues each, so that scores spread and few reach the floor."""
    return sql.replace(USER, DAY_OF_USER)


ISSUES = {
    "dataset_id": USER, "session_id": "concat('', CAST(ts AS DATE))", "issue_id": "concat('i', event_id)",
    "issue_type": "CASE event_type WHEN 'view' THEN 'missing_values' WHEN 'click' THEN 'format_error' WHEN 'purchase' THEN 'anomaly' "
                  "WHEN 'signup' THEN 'type_mismatch' ELSE 'constraint_violation' END",
    "severity": "CASE WHEN value < 10 THEN 'low' WHEN value < 40 THEN 'medium' WHEN value < 150 THEN 'high' ELSE 'critical' END",
    "column": "CASE WHEN event_id % 10 = 9 THEN NULL ELSE concat('c', event_id % 4) END",
    "affected_count": "event_id % 50 + 1", "affected_percentage": "CAST(event_id % 40 AS DOUBLE)",
    "confidence": "CAST(50 + event_id % 50 AS DOUBLE) / 100", "kind": "CASE WHEN event_id % 2 = 0 THEN 'duplicate' ELSE 'other' END", "ts": "ts",
}
ISSUES_SQL = as_sql(ISSUES, "events")


def issues(spark: SparkSession, folder: str, dataset: str = USER) -> DataFrame:
    """Issues of many datasets and sessions: one per event, the user is the dataset (or as given), the day the session."""
    rows = derive(table(spark, folder, "events"), ISSUES | {"dataset_id": dataset})
    return rows.withColumn("details", F.create_map(F.lit("kind"), F.col("kind"))).withColumn("rule_id", F.lit("event"))


SESSIONS_SQL = f"""SELECT dataset_id, session_id, max(ts) AS ts,
  CAST(100 - (7 * count(*) + 13 * sum(CASE WHEN severity IN ('high', 'critical') THEN 1 ELSE 0 END)) % 100 AS DOUBLE) AS quality_score
  FROM ({ISSUES_SQL}) GROUP BY dataset_id, session_id"""


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    severe = F.sum(F.when(F.col("severity").isin("high", "critical"), 1).otherwise(0))
    score = (100 - (7 * F.count(F.lit(1)) + 13 * severe) % 100).cast("double")
    return issues(spark, folder).groupBy("dataset_id", "session_id").agg(F.max("ts").alias("ts"), score.alias("quality_score"))


FEEDBACK = {
    "feedback_id": "event_id", "ts": "ts", "target_id": "concat('t', event_id % 5000)",
    "target_type": "CASE event_type WHEN 'view' THEN 'issue' WHEN 'click' THEN 'proposal' ELSE 'decision' END",
    "is_correct": "CASE WHEN value < 5 THEN NULL ELSE value > 20 END",
    "user_correction": "CASE WHEN event_id % 30 = 0 THEN concat('use ', event_id) END",
    "correction_type": "CASE event_id % 4 WHEN 0 THEN 'impute_median' WHEN 1 THEN 'clip_values' WHEN 2 THEN 'delete_row' ELSE 'cast_type' END",
}
FEEDBACK_SQL = as_sql(FEEDBACK, "events")


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    return derive(table(spark, folder, "events"), FEEDBACK)


DECISIONS = {
    "decision_id": "concat('t', o_orderkey)", "session_id": "concat('s', o_custkey)", "agent": "o_orderpriority",
    "confidence": "CAST(o_orderkey % 100 AS DOUBLE) / 100",
}
DECISIONS_SQL = as_sql(DECISIONS, "orders")


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    return derive(table(spark, folder, "orders"), DECISIONS)


# Column metadata of many datasets: what each user's columns hold, by the events seen.
SEMANTIC = {
    "dataset_id": USER, "column": "concat('c', event_id % 4)",
    "semantic_type": "CASE (user_id + event_id % 4) % 7 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 2 THEN 'age' WHEN 3 THEN 'monetary_amount' "
                     "WHEN 4 THEN 'percentage' WHEN 5 THEN 'identifier' ELSE 'free_text' END",
}
SEMANTIC_SQL = f"SELECT DISTINCT * FROM ({as_sql(SEMANTIC, 'events')})"


def semantic(spark: SparkSession, folder: str, dataset: str = USER) -> DataFrame:
    return derive(table(spark, folder, "events"), SEMANTIC | {"dataset_id": dataset}).distinct()


TOTALS_SQL = f"""SELECT {USER} AS dataset_id, count(*) * 10 AS row_count, 4 AS column_count,
  sum(event_id % 7) AS total_null_count FROM events GROUP BY 1"""


def totals(spark: SparkSession, folder: str, dataset: str = USER) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy(F.expr(dataset).alias("dataset_id")).agg(
        (F.count(F.lit(1)) * 10).alias("row_count"), F.lit(4).alias("column_count"), F.sum(F.expr("event_id % 7")).alias("total_null_count")
    )


# Parameters of the domain queries: profiles a user would keep.
DOMAINS = [
    ("crm", 1, 0.5, ["email", "phone", "age"], ["email", "identifier"], {"email": "critical", "age": "medium"}, ["emails are unique"]),
    ("finance", 2, 0.6, ["monetary_amount", "percentage", "identifier"], ["monetary_amount", "phone"], {"monetary_amount": "high", "percentage": "critical"}, ["amounts are positive"]),
    ("survey", 3, 0.3, ["age", "percentage", "free_text"], ["age"], {"free_text": "high"}, ["ages are 0 to 150"]),
]


def domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(*d, True) for d in DOMAINS],
        "domain_id string, created_at int, min_match_ratio double, trigger_types array<string>, required_types array<string>, "
        "severity_overrides map<string,string>, rules array<string>, active boolean",
    )


def domain_values(field: int) -> str:
    """(domain_id, value...) rows of one list or map field, as SQL VALUES."""
    rows = []
    for d in DOMAINS:
        items = d[field].items() if isinstance(d[field], dict) else [(x,) for x in d[field]]
        rows += [f"('{d[0]}', {', '.join(repr(v) for v in item)})" for item in items]
    return "VALUES " + ", ".join(rows)


TRIGGERS_SQL = "VALUES " + ", ".join(f"('{d[0]}', {d[1]}, {d[2]}, {len(d[3])}, '{t}')" for d in DOMAINS for t in d[3])
DETECTED_SQL = f"""SELECT dataset_id, domain_id, ratio FROM (
  SELECT dataset_id, domain_id, ratio, row_number() OVER (PARTITION BY dataset_id ORDER BY ratio DESC, created_at, domain_id) AS place FROM (
    SELECT s.dataset_id, t.domain_id, t.created_at, t.minimum, CAST(count(*) AS DOUBLE) / t.wanted AS ratio
    FROM (SELECT DISTINCT dataset_id, semantic_type FROM ({SEMANTIC_SQL})) s
    JOIN ({TRIGGERS_SQL}) t(domain_id, created_at, minimum, wanted, semantic_type) USING (semantic_type)
    GROUP BY s.dataset_id, t.domain_id, t.created_at, t.minimum, t.wanted) WHERE ratio >= minimum) WHERE place = 1"""

EARLY = "ts < TIMESTAMP '2024-01-15 00:00:00'"
LATE = "ts >= TIMESTAMP '2024-01-15 00:00:00'"

DRIFTING = {
    "value": "CASE WHEN ts >= TIMESTAMP '2024-01-15 00:00:00' THEN value * 1.3 ELSE value END",
    "steady": "CAST(user_id AS DOUBLE)",
    "kind": "CASE WHEN ts >= TIMESTAMP '2024-01-15 00:00:00' AND event_id % 9 = 0 THEN 'refund' WHEN ts < TIMESTAMP '2024-01-15 00:00:00' AND event_id % 11 = 0 THEN 'trial' ELSE event_type END",
    "ts": "ts", "event_id": "event_id",
}
DRIFTING_SQL = as_sql(DRIFTING, "events")


def drift_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Events before and after mid-January, the later ones with raised values and a new kind."""
    rows = derive(table(spark, folder, "events"), DRIFTING)
    middle = F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    return rows.where(F.col("ts") < middle).drop("ts", "event_id"), rows.where(F.col("ts") >= middle).drop("ts", "event_id")
