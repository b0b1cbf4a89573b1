"""The first rows of an order against a sort, whatever the number of passes."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators.selection import smallest_rows
from plumbline.sources import readers


@pytest.mark.parametrize("n", [0, 40, 777, 3000, 4000])
def test_as_a_sort(spark, n):
    rows = [(i, None if i % 11 == 0 else (i * 7919) % 50, f"k{(i * 31) % 997}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, a int, b string").repartition(5)
    got = sorted(r["id"] for r in smallest_rows(df, ["a", "b", "id"], n, at_once=40, pieces=12).collect())
    want = sorted(r[0] for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[0]))[:n])
    assert got == want


@pytest.mark.parametrize("n", [500, 950])
def test_ties_and_a_hot_key(spark, n):
    """A key that holds most rows: of its rows any will do, the number is exact and smaller keys are all there."""
    rows = [(0 if i < 900 else i,) for i in range(1000)]
    got = sorted(r[0] for r in smallest_rows(spark.createDataFrame(rows, "a int"), ["a"], n, at_once=20, pieces=8).collect())
    assert got == sorted(r[0] for r in rows)[:n]


def test_empty_table_and_odd_names(spark):
    df = spark.createDataFrame([], "`a.b` double, key string")
    assert smallest_rows(df, ["a.b"], 30, at_once=10).count() == 0
    full = spark.createDataFrame([(float("nan"), "x"), (None, "y"), (1.0, "z")] * 20, "`a.b` double, key string")
    assert {r["key"] for r in smallest_rows(full, ["a.b", "key"], 40, at_once=10, pieces=3).collect()} == {"y", "z"}


def test_large_sample_equals_a_sort_by_hash(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    n = df.count() // 2
    by_sort = df.orderBy(F.md5(F.concat_ws("|", F.lit("42"), "l_orderkey", "l_linenumber").cast("binary")), "l_orderkey", "l_linenumber").limit(n)
    from plumbline.operators import selection

    order = [F.md5(F.concat_ws("|", F.lit("42"), "l_orderkey", "l_linenumber").cast("binary")), "l_orderkey", "l_linenumber"]
    assert sorted(selection.smallest_rows(df, order, n, at_once=100, pieces=16).collect()) == sorted(by_sort.collect())
    assert readers.sample_rows(df, ["l_orderkey", "l_linenumber"], n).count() == n
