"""Outliers: an Isolation Forest per numeric column, and rows set against their column.

A tree over one column is a step function of the value, and so is the mean of the trees: a fitted
column is a sorted list of edges with one score per step, of a size set by the parameters.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import predicates as P
from plumbline.functions.expressions import bands, small
from plumbline.operators.checks import details, finish, issue
from plumbline.operators.frequencies import plain_columns, value_frequencies
from plumbline.operators.metrics import column_metrics
from plumbline.operators.ordering import cumulative, quantiles
from plumbline.operators.skew import hot_keys, join_spread

c = F.col
SCALE = 1 << 30


def average_path(n: np.ndarray | float) -> np.ndarray | float:
    """Mean path length of an unsuccessful search in a binary tree of n values."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    safe = np.where(big, n, 3.0)
    return np.where(big, 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe, out)


def _grow(values: np.ndarray, rng: np.random.Generator, depth_limit: int) -> tuple[list[float], list[float]]:
    """Step function of one tree: left edges (the first -inf) and path length right of each edge."""
    edges, paths = [], []
    stack = [(float("-inf"), 0, len(values), 0)]
    while stack:
        edge, lo, hi, depth = stack.pop()
        part = values[lo:hi]
        if hi - lo <= 1 or depth >= depth_limit or part[0] == part[-1]:
            edges.append(edge)
            paths.append(depth + float(average_path(hi - lo)))
            continue
        cut = rng.uniform(part[0], part[-1])
        middle = lo + int(np.searchsorted(part, cut, side="right"))
        if middle == hi:  # the cut fell on the maximum
            cut, middle = part[0], lo + int(np.searchsorted(part, part[0], side="right"))
        stack.append((cut, middle, hi, depth + 1))
        stack.append((edge, lo, middle, depth + 1))
    return edges, paths


@dataclass
class Forest:
    """Fitted columns: {column: (edges, scores)} and the cut below which a score is an outlier."""

    contamination: float
    trees: int
    seed: int
    steps: dict[str, tuple[np.ndarray, np.ndarray]]
    cuts: dict[str, float] = field(default_factory=dict)

    def model_id(self, column: str) -> str:
        return hashlib.md5(f"{column}|{self.contamination}|{self.trees}|{self.seed}".encode()).hexdigest()[:12]

    def score(self, column: str, value: Column) -> Column:
        edges, scores = self.steps[column]

        @F.pandas_udf(T.DoubleType())
        def step(v: pd.Series) -> pd.Series:
            x = v.to_numpy(dtype=float)
            # a value equal to an edge lies left of it
            at = np.clip(np.searchsorted(edges, x, side="left") - 1, 0, len(scores) - 1)
            return pd.Series(np.where(np.isnan(x), np.nan, scores[at]))

        return step(value)


def fit_forest(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, *, contamination: float = 0.1,
               trees: int = 100, sample: int = 256, seed: int = 42, min_rows: int = 10) -> Forest:
    """Trains on hash samples of about ``sample`` rows per tree and column.

    A row is in a sample or not by the hash of its key: the same rows every time, whatever the
    partitions. At most about ``trees * sample`` rows per column leave the scan.
    """
    if not 0 < contamination < 0.5:
        raise ValueError("contamination must lie between 0 and 0.5")
    names = [x for x in (columns or plain_columns(df)) if P.is_numeric(df.schema[x].dataType) and x not in key]
    sizes = {r["column"]: r["n_values"] for r in column_metrics(df, names, []).select("column", "n_values").collect()}
    names = [x for x in names if sizes[x] >= min_rows]
    if not names:
        return Forest(contamination, trees, seed, {})
    pool = trees * sample
    draw = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]), F.lit(SCALE))
    cells = F.array(*[
        F.struct(F.lit(x).alias("column"), F.lit(sample / min(sizes[x], pool)).alias("rate"),
                 F.when(draw < int(SCALE * min(1.0, pool / sizes[x])), P.col(P.as_double(x, df.schema[x].dataType))).alias("value"))
        for x in names
    ])
    pooled = df.select(F.explode(cells).alias("cell"), F.xxhash64(F.lit(seed + 1), *[F.col(k) for k in key]).alias("h")).select("cell.*", "h")
    pooled = pooled.where(c("value").isNotNull())
    drawn = pooled.select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).where(
        F.pmod(F.xxhash64("h", "tree"), F.lit(SCALE)) < c("rate") * SCALE
    )

    def train(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        column, tree = group
        values = np.sort(rows["value"].to_numpy(dtype=float))
        digest = hashlib.sha256(f"{seed}|{column}|{tree}".encode()).digest()
        rng = np.random.default_rng(int.from_bytes(digest[:8], "big"))
        edges, paths = _grow(values, rng, max(1, math.ceil(math.log2(max(len(values), 2)))))
        return pd.DataFrame({"column": [column], "edges": [edges], "paths": [paths], "size": [float(len(values))]})

    def merge(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        edges = np.unique(np.concatenate([np.asarray(e) for e in rows["edges"]]))
        total = np.zeros(len(edges))
        for e, p in zip(rows["edges"], rows["paths"]):
            total += np.asarray(p)[np.searchsorted(np.asarray(e), edges, side="right") - 1]
        norm = float(average_path(rows["size"].mean()))
        scores = -np.power(2.0, -total / len(rows) / max(norm, 1e-12))
        return pd.DataFrame({"column": [group[0]], "edges": [edges], "scores": [scores]})

    grown = drawn.groupBy("column", "tree").applyInPandas(train, "column string, edges array<double>, paths array<double>, size double")
    merged = grown.groupBy("column").applyInPandas(merge, "column string, edges array<double>, scores array<double>")
    # at most columns * trees * sample steps: the model, not the data
    forest = Forest(contamination, trees, seed, {r["column"]: (np.array(r["edges"]), np.array(r["scores"])) for r in merged.collect()})
    forest.cuts = _cuts(df, forest)
    return forest


def _scored_values(df: DataFrame, forest: Forest) -> DataFrame:
    """(column, number, n, score) over the distinct values."""
    freq = value_frequencies(df, list(forest.steps))
    steps = forest.steps

    @F.pandas_udf(T.DoubleType())
    def score(column: pd.Series, v: pd.Series) -> pd.Series:
        out = np.full(len(v), np.nan)
        for name in column.unique():
            edges, scores = steps[name]
            here = (column == name).to_numpy()
            at = np.searchsorted(edges, v.to_numpy(dtype=float)[here], side="left") - 1
            out[here] = scores[np.clip(at, 0, len(scores) - 1)]
        return pd.Series(out)

    return freq.select("column", "number", "n", score("column", "number").alias("score"))


def _cuts(df: DataFrame, forest: Forest) -> dict[str, float]:
    levels = _scored_values(df, forest).groupBy("column", "score").agg(F.sum("n").alias("n"))
    rows = quantiles(levels, ["column"], [forest.contamination], "score")
    return {r["column"]: r["quantiles"][0] for r in rows.collect()}  # one row per column


def detect_outliers(df: DataFrame, forest: Forest, key: Sequence[str]) -> DataFrame:
    """(key..., column, value, score) of the rows under the cut; the score is relative to the cut."""
    scored = df.select(*key, *[
        F.struct(
            P.col(P.as_double(x, df.schema[x].dataType)).alias("value"),
            (forest.score(x, P.col(P.as_double(x, df.schema[x].dataType))) - F.lit(forest.cuts[x])).alias("score"),
        ).alias(f"_s{i}") for i, x in enumerate(forest.steps)
    ])
    long = scored.select(*key, F.explode(F.array(*[
        F.struct(F.lit(x).alias("column"), c(f"_s{i}.value").alias("value"), c(f"_s{i}.score").alias("score"))
        for i, x in enumerate(forest.steps)
    ])).alias("o")).select(*key, "o.*")
    return long.where((c("score") < 0) & c("value").isNotNull())


def outlier_columns(df: DataFrame, forest: Forest) -> DataFrame:
    """(column, anomaly_count, anomaly_percentage, most_extreme_score, model_id), from the distinct values."""
    cut = F.create_map(*[x for k, v in forest.cuts.items() for x in (F.lit(k), F.lit(v))])
    ids = F.create_map(*[x for k in forest.cuts for x in (F.lit(k), F.lit(forest.model_id(k)))])
    relative = c("score") - F.element_at(cut, c("column"))
    rows = _scored_values(df, forest).withColumn("relative", relative)
    hit = c("relative") < 0
    return rows.groupBy("column").agg(
        F.sum(F.when(hit, c("n")).otherwise(0)).alias("anomaly_count"),
        (100.0 * F.sum(F.when(hit, c("n")).otherwise(0)) / F.sum("n")).alias("anomaly_percentage"),
        F.min(F.when(hit, c("relative"))).alias("most_extreme_score"),
    ).withColumn("model_id", F.element_at(ids, c("column")))


def outlier_summary(columns: DataFrame) -> DataFrame:
    worst = F.max_by(F.struct("column", "anomaly_count"), F.struct("anomaly_count", "column"))
    return columns.agg(
        F.sum("anomaly_count").alias("total_anomalies"), F.count(F.lit(1)).alias("columns_affected"), worst.alias("w"),
        F.round(F.avg("anomaly_percentage"), 2).alias("average_anomaly_percentage"),
    ).select("total_anomalies", "columns_affected", c("w.column").alias("most_affected_column"), c("w.anomaly_count").alias("most_affected_count"), "average_anomaly_percentage")


def outlier_issues(columns: DataFrame, dataset_id: str = "table") -> DataFrame:
    n, share = c("anomaly_count"), c("anomaly_percentage")
    words = F.concat(n.cast("string"), F.lit(" unusual values in '"), c("column"), F.lit("'"))
    level = bands(share, [(20, "high"), (5, "medium")], "low", strict=True)
    found = issue("isolation_forest", "anomaly", level, n, share, 0.75, words, details(model_id=c("model_id"), most_extreme_score=c("most_extreme_score")))
    return finish(columns.where(n > 0).select("column", found.alias("i")).select("column", "i.*"), dataset_id)


def column_context(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean, std, p1, p99): the normal range around the outliers of a column."""
    freq = value_frequencies(df, columns).select("column", "number", "n")
    stats = column_metrics(df, columns, ["mean", "std"]).select("column", "mean", "std")
    ends = quantiles(freq, ["column"], [0.01, 0.99])
    return stats.join(small(ends), "column", "left").select(
        "column", "mean", "std", F.get("quantiles", F.lit(0)).alias("p1"), F.get("quantiles", F.lit(1)).alias("p99")
    )


def investigate(df: DataFrame, column: str, key: Sequence[str], rows: Column) -> DataFrame:
    """Rows that meet ``rows``, each set against its column: z-score, percentile, fences, reasons, advice."""
    x = P.col(P.as_double(column, df.schema[column].dataType))
    freq = value_frequencies(df, [column]).select("column", "number", "n")
    moments = column_metrics(df, [column], ["mean", "std", "min", "max"])
    quartiles = quantiles(freq, ["column"], [0.25, 0.5, 0.75])
    stats = moments.join(small(quartiles), "column").select(F.struct(
        "mean", "std", "min", "max", c("n_values").alias("n"), F.get("quantiles", F.lit(0)).alias("q1"),
        F.get("quantiles", F.lit(1)).alias("median"), F.get("quantiles", F.lit(2)).alias("q3"),
    ).alias("s"))
    below = cumulative(freq, ["column"]).select(c("number").alias("value"), c("n_before").alias("below"))
    picked = df.where(rows & x.isNotNull()).select(*key, (x + 0.0).alias("value"))
    hot = hot_keys(freq.select(c("number").alias("value"), "n"), ["value"], "n")
    out = join_spread(picked, below, ["value"], hot, key).withColumn("s", stats.scalar())
    iqr = c("s.q3") - c("s.q1")
    z = F.when(c("s.std") > 0, (c("value") - c("s.mean")) / c("s.std")).otherwise(0.0)
    out = out.select(
        *key, "value", "s", z.alias("z_score"), (100.0 * c("below") / c("s.n")).alias("percentile"), "below",
        (c("value") < c("s.q1") - 1.5 * iqr).alias("under_fence"), (c("value") > c("s.q3") + 1.5 * iqr).alias("over_fence"),
    )
    reasons = F.array_compact(F.array(
        F.when(F.abs("z_score") > 3, "z_score"), F.when(c("under_fence"), "below_iqr_fence"), F.when(c("over_fence"), "above_iqr_fence"),
        F.when(c("percentile") < 1, "first_percentile"), F.when(c("percentile") > 99, "last_percentile"),
    ))
    advice = (
        F.when(F.abs("z_score") > 5, "extreme: check for an entry or measuring error")
        .when(F.abs("z_score") > 3, "significant: look into the source")
        .when(F.size("reasons") > 1, "several signs: check against the business context")
        .otherwise("mild: may be rare but valid")
    )
    return out.withColumn("reasons", reasons).select(
        *key, "value", "z_score", "percentile", (c("under_fence") | c("over_fence")).alias("is_outlier_iqr"),
        "reasons", advice.alias("recommendation"), "below", "s.mean", "s.std", "s.median", "s.q1", "s.q3", "s.min", "s.max",
    )


def nearest_values(df: DataFrame, column: str, targets: DataFrame, reach: int = 2) -> DataFrame:
    """(below, offset, nearby): the values at sorted places below-reach .. below+reach per target.

    ``targets`` holds ``below``, the number of values under the target. A place that any target can
    ask for lies within ``reach`` of the first or last place of some distinct value, so each value
    offers those places and an equality join finds them; nobody scans a range.
    """
    ordered = cumulative(value_frequencies(df, [column]).select("column", "number", "n"), ["column"])
    first, last = c("n_before"), c("n_before") + c("n") - 1
    offers = F.array_distinct(F.filter(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda i: first + i),
            F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda i: last - i),
        ), lambda p: (p >= first) & (p <= last),
    ))
    table = ordered.select(F.explode(offers).alias("place"), c("number").alias("nearby"))
    asked = targets.select("below").distinct().select(
        "below", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("offset")
    ).withColumn("place", c("below") + c("offset"))
    return asked.join(table, "place").select("below", "offset", "nearby")


def outliers(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, contamination: float = 0.1, **options) -> tuple[DataFrame, DataFrame]:
    """Fit and detect in one go: (rows, columns)."""
    forest = fit_forest(df, key, columns, contamination=contamination, **options)
    return detect_outliers(df, forest, key), outlier_columns(df, forest)


