"""Stored baselines that merge: what a later table is compared with when the reference rows are gone.

A baseline is two tables. Numeric columns keep a KLL sketch, whose size doesn't grow with the rows; the others keep exact
counts of their values. Both add up, so a baseline is written a period at a time, and periods are merged without a look at old rows.
A rank read off a sketch is off by ``rank_error`` at most (with the sketch's 99 % confidence), and so is a KS statistic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import predicates as P
from plumbline.functions import pvalues
from plumbline.functions.expressions import slots_below, small
from plumbline.operators import drift as D
from plumbline.operators.frequencies import plain_columns
from plumbline.operators.ordering import cumulative

c = F.col
SKETCH = 2000  # k of the KLL sketch: about 30 kB a column and period
GRID_BITS = 10  # a sketch is read at 2 ** GRID_BITS - 1 ranks
PERIOD = "period"


def rank_error(k: int = SKETCH) -> float:
    """How far a distribution function read off a merged sketch may be from the true one, the grid included."""
    return 2.446 / k**0.9433 + 2.0**-GRID_BITS


def summarise(df: DataFrame, columns: Sequence[str] | None = None, period: Column | str = "all", k: int = SKETCH) -> dict[str, DataFrame]:
    """{"numbers": (period, column, n, sketch), "categories": (period, column, text, n)} of a table, by the value of ``period``.

    Missing values (null, and NaN in numbers) are left out; a column without values has n = 0 and a null sketch.
    """
    columns = list(columns or plain_columns(df))
    numbers = [x for x in columns if P.is_numeric(df.schema[x].dataType)]
    others = [x for x in columns if x not in numbers]
    rows = df.withColumn(PERIOD, (F.lit(period) if isinstance(period, str) else period).cast("string"))
    spark, out = df.sparkSession, {}
    if numbers:
        value = {x: P.col(P.as_double(x, df.schema[x].dataType)) for x in numbers}
        row = rows.groupBy(PERIOD).agg(*[F.struct(F.lit(x).alias("column"), F.count(v).alias("n"), F.when(F.count(v) > 0, F.kll_sketch_agg_double(v, k)).alias("sketch")).alias(f"s{i}") for i, (x, v) in enumerate(value.items())])
        out["numbers"] = row.select(PERIOD, F.explode(F.array(*[f"s{i}" for i in range(len(numbers))])).alias("s")).select(PERIOD, "s.*")
    else:
        out["numbers"] = spark.createDataFrame([], "period string, column string, n long, sketch binary")
    if others:
        cells = F.array(*[F.struct(F.lit(x).alias("column"), F.col(f"`{x}`").cast("string").alias("text")) for x in others])
        out["categories"] = rows.select(PERIOD, F.explode(cells).alias("e")).select(PERIOD, "e.*").where("text is not null").groupBy(PERIOD, "column", "text").agg(F.count(F.lit(1)).alias("n"))
    else:
        out["categories"] = spark.createDataFrame([], "period string, column string, text string, n long")
    return out


def store(baseline: dict[str, DataFrame], path: str) -> None:
    """Writes the periods of a baseline below ``path``; periods that are there already are replaced, others stay."""
    for name, rows in baseline.items():
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PERIOD).parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, periods: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The stored baseline, or some of its periods."""
    kinds = {"numbers": "column string, n long, sketch binary, period string", "categories": "column string, text string, n long, period string"}
    out = {name: spark.read.schema(kind).parquet(f"{path}/{name}") for name, kind in kinds.items()}
    return out if periods is None else {name: rows.where(c(PERIOD).isin(list(periods))) for name, rows in out.items()}


def merged(baseline: dict[str, DataFrame], period: str = "all", k: int = SKETCH) -> dict[str, DataFrame]:
    """All periods as one."""
    numbers = baseline["numbers"].groupBy("column").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch")).withColumn("sketch", F.when(c("n") > 0, c("sketch")))
    categories = baseline["categories"].groupBy("column", "text").agg(F.sum("n").alias("n"))
    return {"numbers": numbers.select(F.lit(period).alias(PERIOD), "column", "n", "sketch"), "categories": categories.select(F.lit(period).alias(PERIOD), "column", "text", "n")}


def _grid(numbers: DataFrame) -> DataFrame:
    """(column, n, grid): the sketch's values at even ranks; a row for each column."""
    size = 1 << GRID_BITS
    ranks = F.array(*[F.lit(i / size) for i in range(1, size)])
    kept = numbers.where("n > 0")
    rows = kept.select("column", c("n").alias("total_ref"), "sketch", F.kll_sketch_get_quantile_double("sketch", ranks).alias("grid"), F.kll_sketch_get_quantile_double("sketch", F.array(F.lit(0.0), F.lit(1.0))).alias("ends"))
    return rows.withColumn("turned", F.reverse(F.transform("grid", lambda x: -x)))


def _before(x: Column) -> Column:
    """Share of the reference below ``x``."""
    return F.when(x <= F.get("ends", F.lit(0)), 0.0).when(x > F.get("ends", F.lit(1)), 1.0).otherwise(slots_below(c("grid"), x, GRID_BITS) / (1 << GRID_BITS))


def _up_to(x: Column) -> Column:
    """Share of the reference up to ``x``, which counts too."""
    return F.when(x < F.get("ends", F.lit(0)), 0.0).when(x >= F.get("ends", F.lit(1)), 1.0).otherwise(1.0 - slots_below(c("turned"), -x, GRID_BITS) / (1 << GRID_BITS))


def kolmogorov_smirnov(baseline: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, statistic, p_value, total_ref, total_cur) of ``current`` against sketches; the statistic is off by ``rank_error`` at most."""
    pairs = D.paired_frequencies(current.limit(0), current, columns)
    totals = pairs.groupBy("column").agg(F.sum("n_cur").alias("total_cur"))
    rows = cumulative(pairs.where("number is not null"), ["column"], "number", ["n_cur"]).join(small(totals), "column").join(small(_grid(baseline).drop("sketch")), "column")
    x = c("number")
    gap = F.greatest(F.abs(_before(x) - c("n_cur_before") / c("total_cur")), F.abs(_up_to(x) - (c("n_cur_before") + c("n_cur")) / c("total_cur")))
    found = rows.groupBy("column", "total_ref", "total_cur").agg(F.max(gap).alias("statistic"))
    return found.withColumn("p_value", pvalues.kolmogorov(c("statistic"), c("total_ref"), c("total_cur")))


def population_stability(baseline: DataFrame, current: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """(column, psi) over the deciles of the sketches, whose shares are read off them too."""
    pairs = D.paired_frequencies(current.limit(0), current, columns)
    probs = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    edges = F.array_distinct(F.kll_sketch_get_quantile_double("sketch", probs))
    cut = _grid(baseline).withColumn("edges", edges).where(F.size("edges") >= 2)
    ranks = cut.select("column", "total_ref", "grid", "turned", "ends", F.posexplode("edges").alias("at", "edge")).select("column", "total_ref", "at", _up_to(c("edge")).alias("rank"))
    upper = ranks.where("at > 0").select("column", c("at").alias("bin"), "rank", "total_ref")
    lower = ranks.select("column", (c("at") + 1).alias("bin"), F.when(c("at") == 0, 0.0).otherwise(c("rank")).alias("from"))
    shares = upper.join(small(lower), ["column", "bin"]).select("column", "bin", ((c("rank") - c("from")) * c("total_ref")).alias("n_ref"))
    counted = D.binned(pairs, cut.select("column", "edges"), bins).select("column", "bin", "n_cur")
    totals = pairs.groupBy("column").agg(F.sum("n_cur").alias("total_cur")).join(small(cut.select("column", "total_ref")), "column")
    return D.psi_from_bins(shares.join(small(counted), ["column", "bin"]), totals)


def paired_categories(baseline: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, number, text, n_ref, n_cur) of categories, as ``drift.paired_frequencies`` has it; the counts of the baseline are exact."""
    now = summarise(current, columns)["categories"]
    both = baseline.where(c("column").isin(list(columns))).select("column", "text", c("n").alias("n_ref"), F.lit(0).cast("long").alias("n_cur")).unionByName(now.select("column", "text", F.lit(0).cast("long").alias("n_ref"), c("n").alias("n_cur")))
    return both.groupBy("column", "text").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur")).select("column", F.lit(None).cast("double").alias("number"), "text", "n_ref", "n_cur")


def drift_against(baseline: dict[str, DataFrame], current: DataFrame, columns: Sequence[str] | None = None, alpha: float = 0.05, min_rows: int = 30) -> DataFrame:
    """``drift.detect_drift`` of ``current`` against a stored baseline (one period: see ``merged``): KS and PSI from the sketches, chi-squared from the counts."""
    columns = list(columns or plain_columns(current))
    numbers = [x for x in columns if P.is_numeric(current.schema[x].dataType)]
    others = [x for x in columns if x not in numbers]
    parts = []
    if numbers:
        rows = kolmogorov_smirnov(baseline["numbers"], current, numbers).join(small(population_stability(baseline["numbers"], current, numbers)), "column", "left")
        tested = c("p_value").isNotNull()
        severity = F.when(tested, D.numeric_severity(c("p_value"), F.coalesce("psi", F.lit(0.0)), alpha)).otherwise("none")
        parts.append(rows.select("column", F.lit("KS-test + PSI").alias("test_used"), "statistic", "p_value", "psi", F.least(F.lit(1.0), F.coalesce("psi", F.lit(0.0)) / D.PSI_LEVELS[2]).alias("drift_score"), severity.alias("severity"), (severity != "none").alias("has_drift"), "total_ref", "total_cur"))
    if others:
        parts.append(D.categorical_drift(paired_categories(baseline["categories"], current, others), alpha))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    enough = (c("total_ref") >= min_rows) & (c("total_cur") >= min_rows)
    return out.withColumns({"severity": F.when(enough, c("severity")).otherwise("none"), "has_drift": enough & c("has_drift"), "test_used": F.when(enough, c("test_used")).otherwise(D.NOT_TESTED), "drift_score": F.when(enough, c("drift_score")).otherwise(0.0)})
