"""Stored baselines: merged periods against the whole, and drift read off them against drift of the rows."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import baselines as B
from plumbline.operators import drift as D


@pytest.fixture(scope="module")
def sides(spark):
    rows = spark.range(6000).select(
        (F.col("id") % 3).cast("string").alias("day"), F.when(F.col("id") % 50 != 0, F.hash("id").cast("double") % 1000).alias("x"), (F.col("id") % 7).cast("int").alias("few"),
        F.concat(F.lit("k"), (F.hash("id") % 4).cast("string")).alias("kind"), F.lit(None).cast("double").alias("dead"),
    )
    now = rows.limit(2500).select("day", (F.col("x") * 1.2 + 30).alias("x"), (F.col("few") % 5).alias("few"), F.when(F.rand(1) < 0.3, "new").otherwise(F.col("kind")).alias("kind"), "dead")
    return rows.cache(), now.cache()


COLUMNS = ["x", "few", "kind", "dead"]


def test_merged_periods_equal_the_whole(sides, spark, tmp_path):
    rows, now = sides
    B.store(B.summarise(rows.where("day <> '2'"), COLUMNS, F.col("day")), f"{tmp_path}/b")
    B.store(B.summarise(rows.where("day = '2'"), COLUMNS, F.col("day")), f"{tmp_path}/b")  # another day, later
    B.store(B.summarise(rows.where("day = '1'"), COLUMNS, F.col("day")), f"{tmp_path}/b")  # the same day again
    stored = B.load(spark, f"{tmp_path}/b")
    assert stored["numbers"].select("period").distinct().count() == 3
    one, whole = B.merged(stored), B.summarise(rows, COLUMNS)
    count = lambda b: sorted((r["column"], r["n"]) for r in b["numbers"].collect())
    assert count(one) == count(whole)
    assert sorted(map(tuple, one["categories"].collect())) == sorted(map(tuple, whole["categories"].collect()))
    for x in ("x", "few"):
        a, b = ({r["column"]: r["statistic"] for r in B.kolmogorov_smirnov(t["numbers"], now, [x]).collect()}[x] for t in (one, whole))
        assert a == pytest.approx(b, abs=2 * B.rank_error())
    assert B.load(spark, f"{tmp_path}/b", ["0", "1"])["numbers"].select("period").distinct().count() == 2


@pytest.mark.parametrize("k", [200, 2000])
def test_drift_against_a_baseline(sides, k):
    rows, now = sides
    got = {r["column"]: r for r in B.drift_against(B.summarise(rows, COLUMNS, k=k), now, COLUMNS).collect()}
    want = {r["column"]: r for r in D.detect_drift(rows, now, COLUMNS).collect()}
    for x in ("x", "few"):
        assert got[x]["statistic"] == pytest.approx(want[x]["statistic"], abs=B.rank_error(k))
        assert (got[x]["severity"], got[x]["total_ref"], got[x]["total_cur"]) == (want[x]["severity"], want[x]["total_ref"], want[x]["total_cur"])
    assert got["x"]["psi"] == pytest.approx(want["x"]["psi"], rel=0.15)
    assert got["kind"]["statistic"] == pytest.approx(want["kind"]["statistic"]) and got["kind"]["has_drift"]
    assert "dead" not in got or not got["dead"]["has_drift"]


def test_no_drift_against_itself(sides):
    rows, _ = sides
    got = {r["column"]: r for r in B.drift_against(B.summarise(rows, COLUMNS), rows, COLUMNS).collect()}
    assert got["x"]["statistic"] <= B.rank_error() and got["few"]["statistic"] <= B.rank_error()
    assert not any(r["has_drift"] for r in got.values())
