"""Streaming queries, run to the end of the sample tables and read back from the sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.catalog.fixtures import DRIFTING, FEEDBACK, derive
from plumbline.catalog.fixtures import DRIFTING_SQL, EARLY
from plumbline.catalog.tracking import FOLD_SQL
from plumbline.operators import drift as D
from plumbline.session import checkpoint_dir
from plumbline.streaming import streams
from plumbline.streaming.folds import ConfidenceFold, Windowed, WindowFold

c = F.col


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet")


def run_to_end(spark: SparkSession, stream: Windowed) -> DataFrame:
    """Folds a stream over what there is and reads the result; state and output live in the shared folder."""
    fold = WindowFold(spark, f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}", stream)
    fold.write().trigger(availableNow=True).start().awaitTermination()
    return fold.result()


# Each session is one event here.
SCORE = "CAST(event_id % 101 AS DOUBLE)"


@query(f"""SELECT CAST(CAST(day AS DATE) AS VARCHAR) AS day, sessions, round(score, 6) AS avg_quality_score, low, high FROM (SELECT date_trunc('day', ts) AS day, count(*) AS sessions, avg({SCORE}) AS score, count(*) FILTER (WHERE {SCORE} < 20) AS low, count(*) FILTER (WHERE {SCORE} >= 80) AS high FROM events GROUP BY 1)""")
def dashboard_stream(spark, folder):
    sessions = event_stream(spark, folder).select(c("ts").cast("timestamp").alias("ts"), F.expr(SCORE).alias("quality_score"))
    out = run_to_end(spark, streams.dashboard_by_day(sessions))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "sessions", F.round("avg_quality_score", 6).alias("avg_quality_score"), c("bucket_0_20").alias("low"), c("bucket_80_100").alias("high"))


@query(f"""SELECT CAST(CAST(day AS DATE) AS VARCHAR) AS day, "column", n_rows, round(nulls, 6) AS null_share, round(hidden, 6) AS pseudo_null_share FROM (
  SELECT date_trunc('day', ts) AS day, 'value' AS "column", count(*) AS n_rows, avg(CASE WHEN event_id % 5 = 0 THEN 1.0 ELSE 0.0 END) AS nulls, 0.0 AS hidden FROM events GROUP BY 1
  UNION ALL SELECT date_trunc('day', ts), 'kind', count(*), 0.0, avg(CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE 0.0 END) FROM events GROUP BY 1)""")
def quality_stream(spark, folder):
    rows = event_stream(spark, folder).select(
        c("ts").cast("timestamp").alias("ts"), F.expr("CASE WHEN event_id % 5 = 0 THEN double('nan') ELSE value END").alias("value"),
        F.expr("CASE WHEN event_id % 4 = 0 THEN ' N/A ' ELSE event_type END").alias("kind"))
    out = run_to_end(spark, streams.quality_by_window(rows, "ts"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "column", "n_rows", F.round("null_share", 6).alias("null_share"), F.round("pseudo_null_share", 6).alias("pseudo_null_share"))


@query("SELECT 'batch_0' AS dataset_id, 'missing_values' AS rule_id, CASE WHEN avg(CASE WHEN event_id % 5 = 0 THEN 1.0 ELSE 0.0 END) >= 0.1 THEN 'medium' ELSE 'low' END AS severity, 'value' AS \"column\", count(*) FILTER (WHERE event_id % 5 = 0) AS affected_count FROM events")
def batch_check_stream(spark, folder):
    path = f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    rows = event_stream(spark, folder).withColumn("value", F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END"))

    def sink(issues: DataFrame, batch_id: int) -> None:
        issues.write.mode("overwrite").parquet(f"{path}/issues/batch_id={batch_id}")

    q = streams.check_each_batch(rows, sink, f"{path}/state", ["missing_values", "pseudo_nulls"]).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/issues").select("dataset_id", "rule_id", "severity", "column", "affected_count")


@query(FOLD_SQL)
def confidence_stream(spark, folder):
    fold = ConfidenceFold(spark, f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}", derive(event_stream(spark, folder), FEEDBACK))
    fold.write().trigger(availableNow=True).start().awaitTermination()
    return fold.result()


@query(f"""WITH t AS (SELECT ts, value FROM ({DRIFTING_SQL})), r AS (SELECT value FROM t WHERE {EARLY}), e AS (SELECT list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM r),
  rb AS (SELECT bin, count(*) / CAST((SELECT count(*) FROM r) AS DOUBLE) + 1e-10 AS pr FROM (SELECT greatest(1, len(list_filter(e, lambda b: b < value))) AS bin FROM r, e) GROUP BY bin),
  d AS (SELECT date_trunc('day', ts) AS day, count(*) AS total FROM t GROUP BY 1),
  qb AS (SELECT date_trunc('day', ts) AS day, greatest(1, len(list_filter(e, lambda b: b < value))) AS bin, count(*) AS n FROM t, e WHERE value BETWEEN e[1] AND e[-1] GROUP BY 1, 2)
  SELECT CAST(CAST(d.day AS DATE) AS VARCHAR) AS day, d.total, round(sum((coalesce(n, 0) / CAST(d.total AS DOUBLE) + 1e-10 - pr) * ln((coalesce(n, 0) / CAST(d.total AS DOUBLE) + 1e-10) / pr)), 6) AS psi
  FROM d JOIN rb ON true LEFT JOIN qb ON qb.day = d.day AND qb.bin = rb.bin GROUP BY d.day, d.total""")
def drift_stream(spark, folder):
    """Each day of events against the deciles of the first half of January."""
    early = derive(spark.read.parquet(f"{folder}/events.parquet"), DRIFTING).where(c("ts") < F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")).select("value")
    bins = D.baseline(early, ["value"])["bins"].orderBy("bin").collect()  # ten rows
    edges, shares = bins[0]["edges"], [b["n_ref"] / b["total_ref"] for b in bins]
    rows = derive(event_stream(spark, folder), DRIFTING).select(c("ts").cast("timestamp").alias("ts"), "value")
    out = run_to_end(spark, streams.window_drift(rows, "ts", "value", edges, shares))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "total", F.round("psi", 6).alias("psi"))
