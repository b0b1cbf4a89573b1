"""Streams folded batch by batch into tables: only what a batch changes is written, and a batch that runs again changes nothing.

A fold lives in a folder of the shared file system. Each micro-batch reads the state that the batch before it left, and writes
its results, its state and the rows that came too late under its own number, replacing what an earlier try left there. The
state holds open windows only, so it shrinks as they close.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from plumbline.operators.feedback import confidence_fold
from plumbline.session import cut_lineage, remove

c = F.col


@dataclass
class Windowed:
    """What is counted per time window and key: ``sums`` are aggregates of ``rows`` that add up over batches; ``finish`` makes the result of them."""

    rows: DataFrame
    time: str
    sums: Mapping[str, Column]
    finish: Callable[[DataFrame], DataFrame]
    keys: Sequence[str] = field(default_factory=list)
    width: str = "1 day"


def _at(path: str, table: str, batch_id: int) -> str:
    return f"{path}/{table}/batch_id={batch_id}"


class WindowFold:
    """Folds ``Windowed`` rows under ``path``. A window is open until the latest event time of earlier batches is ``delay`` past its end.

    Rows of a closed window, and rows without a time, go to a table of their own instead of changing a result that was final.
    """

    def __init__(self, spark: SparkSession, path: str, what: Windowed, delay: str = "1 day"):
        self.spark, self.path, self.what, self.delay = spark, path, what, delay
        self.by = ["window_start", *what.keys]

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        """One micro-batch; to be run again with the same number after a failure."""
        spark, what = rows.sparkSession, self.what
        time = c(what.time).cast("timestamp")
        window = F.window(F.coalesce(time, F.timestamp_seconds(F.lit(0))), what.width)  # which would leave out rows without a time
        timed = lambda edge: F.when(time.isNotNull(), window[edge])
        before = spark.read.parquet(_at(self.path, "seen", batch_id - 1)).first() if batch_id else None
        closed = F.lit(before["latest"] if before else None).cast("timestamp") - F.expr(f"INTERVAL {self.delay}")
        stamped = cut_lineage(rows.withColumns({"window_start": timed("start"), "_end": timed("end")}))
        late = c("_end").isNull() | F.coalesce(c("_end") <= closed, F.lit(False))
        stamped.where(late).drop("window_start", "_end").write.mode("overwrite").parquet(_at(self.path, "late", batch_id))

        added = stamped.where(~late).groupBy(*self.by, "_end").agg(*[v.alias(k) for k, v in what.sums.items()]).withColumn("_new", F.lit(True))
        if batch_id:
            added = added.unionByName(spark.read.parquet(_at(self.path, "state", batch_id - 1)).withColumn("_new", F.lit(False)))
        merged = cut_lineage(added.groupBy(*self.by, "_end").agg(*[F.sum(k).alias(k) for k in what.sums], F.max("_new").alias("_new")))
        what.finish(merged.where("_new").drop("_end", "_new")).write.mode("overwrite").parquet(_at(self.path, "out", batch_id))

        seen = stamped.agg(F.max(time).alias("latest")).select(F.greatest("latest", F.lit(before["latest"] if before else None).cast("timestamp")).alias("latest"))
        latest = seen.first()["latest"]
        still_open = F.coalesce(c("_end") > F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {self.delay}"), F.lit(True))
        merged.where(still_open).drop("_new").write.mode("overwrite").parquet(_at(self.path, "state", batch_id))
        spark.createDataFrame([(latest,)], "latest timestamp").write.mode("overwrite").parquet(_at(self.path, "seen", batch_id))
        for table in ("state", "seen"):  # a batch is run again with the state of the one before it at most
            remove(spark, _at(self.path, table, batch_id - 2))

    def write(self) -> DataStreamWriter:
        return self.what.rows.writeStream.outputMode("append").foreachBatch(self.batch).option("checkpointLocation", f"{self.path}/checkpoint")

    def result(self) -> DataFrame:
        """The latest row of each window and key, open windows included."""
        out = self.spark.read.parquet(f"{self.path}/out")
        rest = [x for x in out.columns if x not in (*self.by, "batch_id")]
        return out.groupBy(*self.by).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*self.by, "_r.*")

    def late(self) -> DataFrame:
        """The rows that changed no window, with their batch."""
        return self.spark.read.parquet(f"{self.path}/late")

    def state(self) -> DataFrame:
        """The sums of the windows that are open after the last batch."""
        rows = self.spark.read.parquet(f"{self.path}/state")
        return rows.where(c("batch_id") == rows.agg(F.max("batch_id")).scalar()).drop("batch_id")


class ConfidenceFold:
    """The confidence of each check after all feedback so far, moved by the feedback of each micro-batch in event-time order.

    The feedback of a batch is composed to one clamped step a check (``feedback.confidence_fold``), in parallel however much
    of it one check holds; the state is a row for each check.
    """

    def __init__(self, spark: SparkSession, path: str, feedback: DataFrame, check: str = "target_type"):
        self.spark, self.path, self.feedback, self.check = spark, path, feedback, check

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        before = spark.read.parquet(_at(self.path, "state", batch_id - 1)) if batch_id else None
        confidence_fold(rows, self.check, before).write.mode("overwrite").parquet(_at(self.path, "state", batch_id))
        remove(spark, _at(self.path, "state", batch_id - 2))

    def write(self) -> DataStreamWriter:
        return self.feedback.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.path}/checkpoint")

    def result(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/state")
        return rows.where(c("batch_id") == rows.agg(F.max("batch_id")).scalar()).drop("batch_id")
