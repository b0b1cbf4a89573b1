"""The rows behind an issue: the first keys and values that meet each of many conditions, from one scan.

Each row is unfolded to the conditions it meets. A ranking per condition with a constant limit lets Spark keep only the first k
rows of each condition in every task before anything is shuffled, so what crosses it is bounded by the tasks and not by the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import predicates as P
from plumbline.operators.frequencies import plain_columns

ENTRIES_PER_SCAN = 256  # wider tables are read in slices, to keep generated code small


def first_rows_of_each(df: DataFrame, key: Sequence[str], conditions: Mapping[str, tuple[Column, Column]], k: int) -> DataFrame:
    """(condition, place, key..., value): the first ``k`` rows in ``key`` order, then by value, that meet each named condition.

    ``conditions`` holds a predicate and the value to show (as text) under each name. Equal keys and values stay apart.
    """
    names = list(conditions)
    parts = []
    for lo in range(0, len(names), ENTRIES_PER_SCAN):
        slice_ = names[lo : lo + ENTRIES_PER_SCAN]
        entries = F.array(*[F.when(conditions[n][0], F.struct(F.lit(lo + i).alias("at"), conditions[n][1].cast("string").alias("value"))) for i, n in enumerate(slice_)])
        met = F.filter(entries, lambda e: e.isNotNull())
        rows = df.select(*[F.col(f"`{x}`").alias(f"_k{i}") for i, x in enumerate(key)], F.explode(met).alias("e"))
        order = W.partitionBy("at").orderBy(*[f"_k{i}" for i in range(len(key))], "value")
        ranked = rows.select("e.at", *[f"_k{i}" for i in range(len(key))], "e.value").withColumn("place", F.row_number().over(order))
        parts.append(ranked.where(F.col("place") <= k))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("at") + 1)
    return out.select(name.alias("condition"), "place", *[F.col(f"_k{i}").alias(x) for i, x in enumerate(key)], "value")


def broken_by(rule_id: str, column: str, df: DataFrame) -> Column | None:
    """Whether a row is counted by a column check; null for checks that judge no single rows (repeats, outliers, drift)."""
    dtype, v = df.schema[column].dataType, P.quoted(column)
    number = P.as_double(column, dtype) if P.is_numeric(dtype) else P.to_number(v) if P.is_text(dtype) else None
    if rule_id == "missing_values":
        return P.col(P.missing(v, dtype))
    if rule_id == "pseudo_nulls" and P.is_text(dtype):
        return P.col(P.is_pseudo_null(v))
    if rule_id == "mixed_types" and P.is_text(dtype):
        return P.col(f"{v} is not null and {P.to_number(v)} is null")
    if rule_id == "format" and P.is_text(dtype) and (shape := P.format_of_name(column)):
        return P.col(f"{v} is not null and not {P.is_pseudo_null(v)} and not {P.has_format(v, shape)}")
    if number and rule_id in ("negative_amount", "percentage_range", "age_range"):
        bound = {"negative_amount": f"{number} < 0", "percentage_range": f"{number} < 0 or {number} > 100", "age_range": f"{number} < 0 or {number} > 150"}[rule_id]
        return P.col(bound)
    return None


def evidence(df: DataFrame, issues: DataFrame, key: Sequence[str], k: int = 100) -> DataFrame:
    """(rule_id, column, place, key..., value): the first ``k`` rows behind each issue of a column check, all from one scan.

    ``issues`` holds a row for each column and rule, which is what is collected.
    """
    found = [(r["rule_id"], r["column"]) for r in issues.select("rule_id", "column").where("column is not null").distinct().orderBy("rule_id", "column").collect()]
    conditions, place = {}, {}
    for rule, column in found:
        predicate = broken_by(rule, column, df) if column in df.columns else None
        if predicate is not None:
            name = f"{rule}:{column}"
            conditions[name], place[name] = (predicate, F.col(f"`{column}`")), (rule, column)
    kinds = ", ".join(f"`{x}` {df.schema[x].dataType.simpleString()}" for x in key)
    if not conditions:
        return df.sparkSession.createDataFrame([], f"rule_id string, column string, place int, {kinds}, value string")
    rows = first_rows_of_each(df, key, conditions, k)
    pick = lambda i: F.element_at(F.array(*[F.lit(place[n][i]) for n in conditions]), F.array_position(F.array(*[F.lit(n) for n in conditions]), F.col("condition")).cast("int"))
    return rows.select(pick(0).alias("rule_id"), pick(1).alias("column"), "place", *[f"`{x}`" for x in key], "value")


def with_evidence(issues: DataFrame, found: DataFrame, key: Sequence[str], samples: int = 10) -> DataFrame:
    """``issues`` with row_keys (array of key structs) and samples (the first ``samples`` values) from ``evidence``; both bounded by its ``k``."""
    entry = F.struct("place", F.struct(*[f"`{x}`" for x in key]).alias("key"), "value")
    held = found.groupBy("rule_id", "column").agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    rows = held.select("rule_id", "column", F.transform("_e", lambda e: e["key"]).alias("row_keys"), F.transform(F.filter("_e", lambda e: e["place"] <= samples), lambda e: e["value"]).alias("samples"))
    return issues.join(F.broadcast(rows), ["rule_id", "column"], "left")


def sample_of_columns(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """(column, place, key..., value): the first ``k`` values of each column in ``key`` order, missing ones left out."""
    names = list(columns) if columns is not None else [x for x in plain_columns(df) if x not in key]
    present = {x: (~P.col(P.missing(P.quoted(x), df.schema[x].dataType)), F.col(f"`{x}`")) for x in names}
    return first_rows_of_each(df, key, present, k).withColumnRenamed("condition", "column")
