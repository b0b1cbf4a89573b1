"""The running figures of the engine as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import predicates as P
from plumbline.operators import checks as C
from plumbline.operators.drift import EPSILON
from plumbline.operators.history import score_bucket
from plumbline.streaming.folds import Windowed

c = F.col


def dashboard_by_day(sessions: DataFrame) -> Windowed:
    """Sessions, mean score and score buckets per day."""
    bucket = score_bucket(c("quality_score"))
    buckets = {f"bucket_{b.replace('-', '_')}": F.count_if(bucket == b) for b in ["0-20", "20-40", "40-60", "60-80", "80-100"]}
    sums = {"sessions": F.count(F.lit(1)), "_scored": F.count("quality_score"), "_total": F.sum("quality_score"), **buckets}

    def finish(rows: DataFrame) -> DataFrame:
        return rows.select("window_start", "sessions", F.try_divide("_total", "_scored").alias("avg_quality_score"), *buckets)

    return Windowed(sessions, "ts", sums, finish)


def check_each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, checks: Sequence[str] = C.STANDARD, **options) -> Any:
    """Runs the batch checks on every micro-batch; ``sink`` gets the issues and the batch id, the same again if a batch is run again."""
    def batch(df: DataFrame, batch_id: int) -> None:
        if not df.isEmpty():
            sink(C.column_issues(df, checks, dataset_id=f"batch_{batch_id}", **options), batch_id)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def quality_by_window(stream: DataFrame, time: str, width: str = "1 day", columns: Sequence[str] | None = None) -> Windowed:
    """Null and disguised-null shares per column and time window."""
    names = [x for x in (columns or stream.columns) if x != time]
    entries = []
    for x in names:
        dtype = stream.schema[x].dataType
        v = P.quoted(x)
        hidden = P.col(P.is_pseudo_null(v)) if P.is_text(dtype) else F.lit(False)
        entries.append(F.struct(F.lit(x).alias("column"), P.col(P.missing(v, dtype)).cast("int").alias("null"), F.coalesce(hidden, F.lit(False)).cast("int").alias("hidden")))
    long = stream.select(c(time), F.explode(F.array(*entries)).alias("e")).select(time, "e.*")

    def finish(rows: DataFrame) -> DataFrame:
        return rows.select("window_start", "column", "n_rows", (c("_null") / c("n_rows")).alias("null_share"), (c("_hidden") / c("n_rows")).alias("pseudo_null_share"))

    return Windowed(long, time, {"n_rows": F.count(F.lit(1)), "_null": F.sum("null"), "_hidden": F.sum("hidden")}, finish, ["column"], width)


def window_drift(stream: DataFrame, time: str, column: str, edges: Sequence[float], reference: Sequence[float], width: str = "1 day") -> Windowed:
    """(window_start, total, psi): each window of the stream against the baseline's shares per bin; values outside its edges fall into no bin."""
    x = P.col(P.as_double(column, stream.schema[column].dataType))
    bin_of = F.lit(1)
    for i, edge in enumerate(edges[1:-1], start=2):
        bin_of = F.when(x > edge, F.lit(i)).otherwise(bin_of)
    inside = F.when(x.between(edges[0], edges[-1]), bin_of)
    sums = {"total": F.count(F.lit(1)), **{f"_bin{i}": F.count_if(inside == i) for i in range(1, len(edges))}}

    def finish(rows: DataFrame) -> DataFrame:
        psi = F.lit(0.0)
        for i, share in enumerate(reference, start=1):
            r, q = F.lit(share + EPSILON), c(f"_bin{i}") / c("total") + EPSILON
            psi = psi + (q - r) * F.log(q / r)
        return rows.select("window_start", "total", psi.alias("psi"))

    return Windowed(stream.where(x.isNotNull()), time, sums, finish, [], width)
