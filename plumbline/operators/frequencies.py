"""Value frequencies: one row per (column, distinct value), the base of all exact distinct work.

Long form plus ``groupBy`` keeps the map-side combine: a value held by a third of the rows arrives
at the shuffle once per task. Several ``count_distinct`` in one aggregate would instead multiply the
rows by the number of columns before a shuffle of everything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import predicates as P


def plain_columns(df: DataFrame) -> list[str]:
    """Columns that hold one value per cell; nested ones have no place in a value count."""
    return [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def cells(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Array with one struct (column, number, text) per listed column, to be exploded."""
    out = []
    for name in columns or plain_columns(df):
        dtype = df.schema[name].dataType
        if P.is_numeric(dtype):
            # + 0 folds -0.0 into 0.0
            number, text = f"{P.as_double(name, dtype)} + 0.0D", "cast(null as string)"
        else:
            number, text = "cast(null as double)", f"cast({P.quoted(name)} as string)"
        out.append(f"named_struct('column', {P.literal(name)}, 'number', {number}, 'text', {text})")
    return F.expr(f"array({', '.join(out)})")


def value_frequencies(df: DataFrame, columns: Sequence[str] | None = None, *, digest_over: int | None = None) -> DataFrame:
    """(column, number, text, n): how often each non-null value occurs.

    Numbers and texts are counted apart, each from a scan of its own columns, under the position of
    the column: short keys of fixed width where they can be. ``digest_over``: texts longer than this
    are counted under the SHA-256 of the whole text, which keeps long texts out of the shuffle where
    only their distinctness matters.
    """
    columns = list(columns or plain_columns(df))
    names = "array(" + ", ".join(P.literal(x) for x in columns) + ")"
    parts = []
    for numeric in (True, False):
        entries = []
        for i, name in enumerate(columns):
            dtype = df.schema[name].dataType
            if P.is_numeric(dtype) != numeric:
                continue
            # + 0 folds -0.0 into 0.0
            value = f"{P.as_double(name, dtype)} + 0.0D" if numeric else f"cast({P.quoted(name)} as string)"
            if not numeric and digest_over is not None and P.is_text(dtype):
                value = f"if(octet_length({value}) > {digest_over}, concat('sha256:', sha2({value}, 256)), {value})"
            entries.append(f"struct({i} as at, {value} as value)")
        if not entries:
            continue
        counted = df.selectExpr(f"inline(array({', '.join(entries)}))").where("value is not null").groupBy("at", "value").agg(F.count(F.lit(1)).alias("n"))
        kinds = ("value", "cast(null as string)") if numeric else ("cast(null as double)", "value")
        parts.append(counted.selectExpr(f"element_at({names}, at + 1) as column", f"{kinds[0]} as number", f"{kinds[1]} as text", "n"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def distinct_counts(freq: DataFrame) -> DataFrame:
    """(column, n_distinct, n_values) from value frequencies."""
    return freq.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n_values"))


def top_values(freq: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values per column, ties by value; Spark limits per task first."""
    order = W.partitionBy("column").orderBy(F.desc("n"), F.asc("number"), F.asc("text"))
    return freq.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def approximate_distinct(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Opt-in sketch of the distinct counts: one scan, no shuffle of values."""
    columns = list(columns or plain_columns(df))
    row = df.agg(*[
        F.approx_count_distinct(P.col(P.present(P.quoted(c), df.schema[c].dataType))).alias(str(i))
        for i, c in enumerate(columns)
    ])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(str(i)).alias("n_distinct")) for i, c in enumerate(columns)
    ])).alias("r")).select("r.*")


