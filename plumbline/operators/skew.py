"""Joins to a keyed table that stay even when one key holds much of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import small

HOT_SHARE = 1000  # a key is hot if it carries more than 1/HOT_SHARE of its group's rows
SALTS = 64


def hot_keys(counts: DataFrame, on: Sequence[str], weight: str, group: Sequence[str] = ()) -> DataFrame:
    """The hot keys of a table of key counts: by definition fewer than HOT_SHARE per ``group``."""
    totals = counts.groupBy(*group).agg(F.sum(weight).alias("_total"))
    if group:
        sized = counts.join(small(totals), list(group))
    else:
        sized = counts.withColumn("_total", totals.scalar())
    return sized.where(F.col(weight) * HOT_SHARE > F.col("_total")).select(*on, F.lit(True).alias("_hot"))


def join_spread(rows: DataFrame, table: DataFrame, on: Sequence[str], hot: DataFrame, spread_by: Sequence[str]) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row per key).

    The rows of a hot key are spread over SALTS parts by a hash of ``spread_by``; its table row is
    repeated once per part. All other keys are joined as they are.
    """
    on = list(on)
    part = F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int")
    salted = rows.join(small(hot), on, "left").withColumn("_salt", F.when(F.col("_hot"), part).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    entries = table.join(small(hot), on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(entries, [*on, "_salt"]).drop("_salt")
