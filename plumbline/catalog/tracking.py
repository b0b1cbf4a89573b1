"""Queries on history, feedback and decisions, and on reading text that holds tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.catalog import query
from plumbline.catalog.fixtures import (
    DECISIONS_SQL, FEEDBACK_SQL, ISSUES_SQL, SEMANTIC_SQL, SESSIONS_SQL, decisions, feedback, issues, semantic, sessions, table,
)
from plumbline.operators import feedback as B
from plumbline.operators import history as H
from plumbline.operators import scoring as S
from plumbline.sources import readers, writers

c = F.col
KEPT_SQL = f"SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY ts DESC, session_id DESC) AS place FROM ({SESSIONS_SQL})"
TREND_SQL = f"""SELECT *, CASE WHEN kept <= 1 THEN 'new' WHEN kept < 3 THEN 'stable' WHEN last_score > previous + 5 THEN 'improving' WHEN last_score < previous - 5 THEN 'degrading' ELSE 'stable' END AS trend FROM (
  SELECT dataset_id, count(*) AS kept, max(CASE WHEN place = 1 THEN quality_score END) AS last_score, avg(CASE WHEN place > 1 THEN quality_score END) AS previous FROM ({KEPT_SQL}) WHERE place <= 10 GROUP BY dataset_id)"""


@query(f"SELECT dataset_id, session_id, quality_score, CAST(place AS INT) AS place FROM ({KEPT_SQL}) WHERE place <= 10")
def recent_sessions(spark, folder):
    return H.recent_sessions(sessions(spark, folder)).select("dataset_id", "session_id", "quality_score", "place")


@query(f"SELECT dataset_id, kept, last_score, round(previous, 6) AS previous_avg, trend FROM ({TREND_SQL})")
def score_trends(spark, folder):
    return H.trends(sessions(spark, folder)).withColumn("previous_avg", F.round("previous_avg", 6))


@query(f"SELECT h.*, trend FROM (SELECT dataset_id, count(*) AS session_count, round(avg(quality_score), 2) AS avg_quality_score, CAST(min(ts) AS VARCHAR) AS first_seen, CAST(max(ts) AS VARCHAR) AS last_seen FROM ({SESSIONS_SQL}) GROUP BY dataset_id) h JOIN ({TREND_SQL}) USING (dataset_id)")
def dataset_history(spark, folder):
    rows = H.dataset_history(sessions(spark, folder))
    return rows.withColumn("first_seen", c("first_seen").cast("string")).withColumn("last_seen", c("last_seen").cast("string"))


@query(f"SELECT dataset_id, issue_type, n, CAST(place AS INT) AS place FROM (SELECT dataset_id, issue_type, count(*) AS n, row_number() OVER (PARTITION BY dataset_id ORDER BY count(*) DESC, issue_type) AS place FROM ({ISSUES_SQL}) GROUP BY dataset_id, issue_type) WHERE place <= 3")
def recurring_issue_types(spark, folder):
    return H.recurring_issue_types(issues(spark, folder))


PROBLEMS_SQL = f"SELECT dataset_id, \"column\", count(DISTINCT session_id) AS sessions FROM ({ISSUES_SQL}) WHERE \"column\" IS NOT NULL GROUP BY ALL"


@query(PROBLEMS_SQL)
def problem_columns(spark, folder):
    return H.problem_columns(issues(spark, folder))


@query(f"""WITH n AS (SELECT dataset_id, count(DISTINCT session_id) AS total FROM ({SESSIONS_SQL}) GROUP BY dataset_id),
  t AS (SELECT dataset_id, issue_type FROM (SELECT dataset_id, issue_type, count(DISTINCT session_id) AS hit FROM ({ISSUES_SQL}) WHERE issue_type IN ('missing_values', 'format_error') GROUP BY ALL) JOIN n USING (dataset_id) WHERE hit / CAST(total AS DOUBLE) > 0.6),
  k AS (SELECT p.dataset_id, p."column", sessions / CAST(total AS DOUBLE) AS share FROM ({PROBLEMS_SQL}) p JOIN n USING (dataset_id) WHERE sessions / CAST(total AS DOUBLE) > 0.6)
  SELECT t.dataset_id, k."column", CASE WHEN issue_type = 'missing_values' THEN 'not_null' ELSE 'strict_format' END AS rule_kind, round(share, 6) AS share FROM t JOIN k USING (dataset_id)
  UNION ALL SELECT dataset_id, NULL, 'audit', NULL FROM ({TREND_SQL}) WHERE trend = 'degrading'""")
def suggested_rules(spark, folder):
    return H.suggested_rules(sessions(spark, folder), issues(spark, folder)).withColumn("share", F.round("share", 6))


@query(f"SELECT count(*) AS total_sessions, round(avg(quality_score), 2) AS avg_quality_score FROM ({SESSIONS_SQL})")
def dashboard_totals(spark, folder):
    return H.dashboard_totals(sessions(spark, folder))


@query(f"SELECT CASE WHEN quality_score < 20 THEN '0-20' WHEN quality_score < 40 THEN '20-40' WHEN quality_score < 60 THEN '40-60' WHEN quality_score < 80 THEN '60-80' ELSE '80-100' END AS bucket, count(*) AS n FROM ({SESSIONS_SQL}) GROUP BY 1")
def score_distribution(spark, folder):
    return H.score_distribution(sessions(spark, folder))


@query(f"SELECT issue_type, count(*) AS n FROM ({ISSUES_SQL}) GROUP BY issue_type ORDER BY n DESC, issue_type LIMIT 5")
def top_issue_types(spark, folder):
    return H.top_issue_types(issues(spark, folder))


@query(f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM ({SESSIONS_SQL}) GROUP BY 1 ORDER BY 1 DESC LIMIT 7")
def sessions_by_day(spark, folder):
    return H.sessions_by_day(sessions(spark, folder)).withColumn("day", c("day").cast("string"))


@query(f"""SELECT s.dataset_id, quality_score, coalesce(n, 0) AS issues_count, coalesce(m, 0) AS missing, cols AS top_columns FROM (SELECT dataset_id, min(quality_score) AS quality_score FROM ({SESSIONS_SQL}) GROUP BY dataset_id) s LEFT JOIN (
  SELECT dataset_id, count(*) AS n, count(*) FILTER (WHERE issue_type = 'missing_values') AS m, array_to_string(list_slice(list_sort(list_distinct(list("column") FILTER (WHERE "column" IS NOT NULL))), 1, 5), ',') AS cols FROM ({ISSUES_SQL}) GROUP BY dataset_id) i USING (dataset_id)""")
def session_records(spark, folder):
    scores = sessions(spark, folder).groupBy("dataset_id").agg(F.min("quality_score").alias("score"))
    rows = H.session_row(issues(spark, folder), scores, "s1", "2024-02-01 00:00:00")
    return rows.select("dataset_id", "quality_score", "issues_count", F.coalesce(F.element_at("issue_counts", "missing_values"), F.lit(0)).alias("missing"), F.array_join("top_columns", ",").alias("top_columns"))


@query(f"""SELECT dataset_id AS "table", concat('dataset_', left(md5(string_agg(concat("column", ':', semantic_type), '|' ORDER BY "column", semantic_type)), 12)) AS dataset_id FROM ({SEMANTIC_SQL}) GROUP BY dataset_id""")
def dataset_identities(spark, folder):
    rows = semantic(spark, folder).select(c("dataset_id").alias("table"), "column", c("semantic_type").alias("dtype"))
    return H.dataset_id_of(rows)


@query("SELECT count(*) AS total, count(*) FILTER (WHERE value >= 5) AS succeeded, count(*) FILTER (WHERE NOT coalesce(value >= 5, false)) AS failed FROM events")
def batch_totals(spark, folder):
    rows = table(spark, folder, "events").select(F.when(c("value") >= 5, "success").otherwise("error").alias("status"))
    return H.batch_totals(rows)


@query(f"SELECT 'decisions' AS store, count(*) AS n FROM ({DECISIONS_SQL}) UNION ALL SELECT 'feedback', count(*) FROM ({FEEDBACK_SQL}) UNION ALL SELECT 'rules', count(*) FROM part")
def store_counts(spark, folder):
    return H.store_counts(decisions=decisions(spark, folder), feedback=feedback(spark, folder), rules=table(spark, folder, "part"))


# Feedback

@query(f"SELECT target_type, count(*) AS total, count(*) FILTER (WHERE is_correct) AS positive, count(*) FILTER (WHERE NOT is_correct) AS negative, round(count(*) FILTER (WHERE is_correct) / CAST(count(*) AS DOUBLE), 6) AS positive_rate FROM ({FEEDBACK_SQL}) GROUP BY ROLLUP (target_type)")
def feedback_stats(spark, folder):
    return B.feedback_stats(feedback(spark, folder)).withColumn("positive_rate", F.round("positive_rate", 6))


@query(f"""SELECT target_id, feedback_count, positive_count, negative_count, round(rate, 3) AS success_rate, coalesce(round((rate - 0.5) * 0.3, 3), 0) AS confidence_adjustment,
  CASE WHEN rate IS NULL THEN 'not_enough_feedback' WHEN rate >= 0.8 THEN 'high_confidence' WHEN rate >= 0.6 THEN 'normal_confidence' WHEN rate >= 0.4 THEN 'verify' ELSE 'caution' END AS recommendation
  FROM (SELECT *, positive_count / CAST(nullif(positive_count + negative_count, 0) AS DOUBLE) AS rate FROM (SELECT target_id, count(*) AS feedback_count, count(*) FILTER (WHERE is_correct) AS positive_count, count(*) FILTER (WHERE NOT is_correct) AS negative_count FROM ({FEEDBACK_SQL}) GROUP BY target_id))""")
def learned_from_feedback(spark, folder):
    return B.learn(feedback(spark, folder), "target_id").drop("first_correction")


@query(f"SELECT correction_type, CAST(place AS INT) AS place, user_correction FROM (SELECT *, row_number() OVER (PARTITION BY correction_type ORDER BY ts, feedback_id) AS place FROM ({FEEDBACK_SQL}) WHERE NOT is_correct AND user_correction IS NOT NULL) WHERE place <= 3")
def past_corrections(spark, folder):
    return B.past_corrections(feedback(spark, folder), "correction_type").withColumn("place", c("place").cast("int"))


FOLD_SQL = f"""WITH RECURSIVE f AS (SELECT target_type, is_correct, row_number() OVER (PARTITION BY target_type ORDER BY ts, feedback_id) AS i, sum(CASE WHEN NOT is_correct THEN 1 ELSE 0 END) OVER (PARTITION BY target_type ORDER BY ts, feedback_id) AS wrong FROM ({FEEDBACK_SQL}) WHERE is_correct IS NOT NULL),
  w(target_type, i, x) AS (SELECT DISTINCT target_type, CAST(0 AS BIGINT), CAST(1.0 AS DOUBLE) FROM f UNION ALL SELECT f.target_type, f.i, CASE WHEN f.is_correct THEN least(0.99, x + 0.02) WHEN f.wrong > 5 THEN greatest(0.5, x - 0.05) ELSE x END FROM w JOIN f ON f.target_type = w.target_type AND f.i = w.i + 1)
  SELECT w.target_type AS check_type, round(arg_max(x, i), 4) AS confidence, (SELECT count(*) FROM f WHERE f.target_type = w.target_type AND NOT is_correct) AS false_positives, (SELECT count(*) FROM f WHERE f.target_type = w.target_type AND is_correct) AS confirmations FROM w GROUP BY w.target_type"""


@query(FOLD_SQL)
def confidence_fold(spark, folder):
    return B.confidence_fold(feedback(spark, folder))


@query(f"SELECT count(*) FILTER (WHERE NOT is_correct) AS false_positives, count(*) FILTER (WHERE is_correct) AS confirmations, count(user_correction) AS examples_added, count(DISTINCT CASE WHEN is_correct THEN target_type END) AS checks_confirmed FROM ({FEEDBACK_SQL})")
def feedback_summary(spark, folder):
    return B.feedback_summary(feedback(spark, folder))


@query(f"SELECT concat('exception_', feedback_id) AS rule_id, concat('false positive: ', target_type, ' ', target_id) AS text, 'exception' AS rule_type, 'low' AS severity FROM ({FEEDBACK_SQL}) WHERE NOT is_correct UNION ALL SELECT concat('example_', feedback_id), concat('correction: ', target_type, ' ', user_correction), 'example', 'low' FROM ({FEEDBACK_SQL}) WHERE user_correction IS NOT NULL")
def rules_from_feedback(spark, folder):
    return B.rules_from_feedback(feedback(spark, folder)).select("rule_id", "text", "rule_type", "severity")


MARKED_SQL = f"""SELECT d.*, v.was_correct FROM ({DECISIONS_SQL}) d LEFT JOIN (SELECT target_id, is_correct AS was_correct FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY ts DESC, feedback_id DESC) AS place FROM ({FEEDBACK_SQL})
  WHERE target_type = 'decision' AND is_correct IS NOT NULL) WHERE place = 1) v ON v.target_id = d.decision_id"""


@query(f"SELECT decision_id, agent, was_correct FROM ({MARKED_SQL})")
def marked_decisions(spark, folder):
    return B.mark_decisions(decisions(spark, folder), feedback(spark, folder)).select("decision_id", "agent", "was_correct")


@query(f"SELECT agent, count(*) AS total_decisions, count(*) FILTER (WHERE was_correct) AS correct, count(*) FILTER (WHERE NOT was_correct) AS incorrect, count(*) FILTER (WHERE was_correct IS NULL) AS unknown, round(count(*) FILTER (WHERE was_correct) / CAST(count(was_correct) AS DOUBLE), 6) AS accuracy FROM ({MARKED_SQL}) GROUP BY agent")
def decision_accuracy(spark, folder):
    return B.decision_accuracy(B.mark_decisions(decisions(spark, folder), feedback(spark, folder))).withColumn("accuracy", F.round("accuracy", 6))


@query(f"SELECT session_id, CASE WHEN sum(confidence) FILTER (WHERE was_correct IS NOT NULL) <> 0 THEN round((sum(CASE WHEN was_correct THEN confidence ELSE 0 END) / sum(confidence) FILTER (WHERE was_correct IS NOT NULL) - 0.5) * 0.4, 3) ELSE 0.0 END AS adjustment FROM ({MARKED_SQL}) WHERE was_correct IS NOT NULL GROUP BY session_id")
def confidence_shifts(spark, folder):
    marked = B.mark_decisions(decisions(spark, folder), feedback(spark, folder)).withColumnRenamed("confidence", "similarity")
    return B.confidence_shift(marked, "session_id")


@query(f"SELECT * FROM ({DECISIONS_SQL}) WHERE session_id = 's7'")
def decisions_of_session(spark, folder):
    return B.decisions_of_session(decisions(spark, folder), "s7")


@query(f"SELECT feedback_id, target_type, is_correct FROM ({FEEDBACK_SQL}) WHERE target_id = 't42'")
def feedback_of_target(spark, folder):
    return B.feedback_of_target(feedback(spark, folder), "t42").select("feedback_id", "target_type", "is_correct")


# Reports and sources

@query(f"""SELECT dataset_id, "column", score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS level FROM (SELECT dataset_id, concat('c', session_id) AS "column", quality_score AS score FROM ({SESSIONS_SQL}))""")
def score_report(spark, folder):
    rows = sessions(spark, folder).select("dataset_id", F.concat(F.lit("c"), "session_id").alias("column"), c("quality_score").alias("score"))
    return rows.select("dataset_id", "column", "score", S.score_band(c("score")).alias("level"))


@query("SELECT custkey, CAST(position AS INT) AS position, orderkey, price FROM (SELECT o_custkey AS custkey, o_orderkey AS orderkey, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position FROM orders)")
def rows_of_json_columns(spark, folder):
    """Orders packed per customer into one JSON object of column arrays, and unpacked again."""
    o = table(spark, folder, "orders")
    packed = o.groupBy(c("o_custkey").alias("custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("r")).select(
        "custkey", F.to_json(F.struct(c("r.o_orderkey").alias("orderkey"), c("r.o_totalprice").alias("price"))).alias("payload"))
    schema = T.StructType([T.StructField("orderkey", T.LongType()), T.StructField("price", T.DoubleType())])
    return readers.rows_of_json_columns(packed, "payload", schema)


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders")
def rows_of_csv_text(spark, folder):
    """Each order as a small CSV text with a header, read back by schema."""
    text = F.format_string("status,price\n%s,%s\n", c("o_orderstatus"), c("o_totalprice").cast("string"))
    packed = table(spark, folder, "orders").select(c("o_orderkey").alias("id"), text.alias("payload"))
    return readers.rows_of_csv_text(packed, "payload", "status string, price double").select("id", "status", "price")


def _written(spark, folder, fmt: str):
    """The customers written to a folder of this run and read back."""
    import uuid

    from plumbline.session import checkpoint_dir

    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df = table(spark, folder, "customer")
    if fmt == "json":
        df.write.json(path)
        return spark.read.schema(df.schema).json(path)
    writers.write_table(df, path, fmt)
    return readers.read_csv(spark, path) if fmt == "csv" else readers.read_parquet(spark, path)


ROUND_TRIP = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query(ROUND_TRIP)
def csv_round_trip(spark, folder):
    return _written(spark, folder, "csv")


@query(ROUND_TRIP)
def json_round_trip(spark, folder):
    return _written(spark, folder, "json")


@query(ROUND_TRIP)
def parquet_round_trip(spark, folder):
    return _written(spark, folder, "parquet")


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000")
def first_rows(spark, folder):
    return readers.first_rows(table(spark, folder, "orders"), ["o_orderkey"], 1000)


@query("SELECT * FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 1000")
def sampled_rows(spark, folder):
    return readers.sample_rows(table(spark, folder, "orders"), ["o_orderkey"], 1000)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT (SELECT count(*) * 2 // 5 FROM lineitem)")
def cheapest_lines(spark, folder):
    """Two fifths of the table, so that no task could take them all at scale."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return readers.first_rows(lines, ["l_extendedprice", "l_orderkey", "l_linenumber"], lines.count() * 2 // 5)


@query("SELECT * FROM lineitem ORDER BY md5('7|' || l_orderkey || '|' || l_linenumber), l_orderkey, l_linenumber LIMIT (SELECT count(*) // 3 FROM lineitem)")
def sampled_third(spark, folder):
    lines = table(spark, folder, "lineitem")
    return readers.sample_rows(lines, ["l_orderkey", "l_linenumber"], lines.count() // 3, seed=7)
