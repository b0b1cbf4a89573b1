import numpy as np
import pytest

from plumbline.operators import correlation, drift, outliers
from plumbline.operators.ordering import positions, quantiles


def frame(spark, values, kinds):
    return spark.createDataFrame(list(zip(map(float, values), kinds)), "value double, category string")


@pytest.fixture(scope="module")
def sides(spark):
    a = frame(spark, np.random.default_rng(42).normal(100, 15, 100), ["A"] * 50 + ["B"] * 50)
    b = frame(spark, np.random.default_rng(123).normal(120, 20, 100), ["A"] * 30 + ["B"] * 50 + ["C"] * 20)
    return a, b


def test_drift_found(sides):
    got = {r["column"]: r for r in drift.detect_drift(*sides).collect()}
    assert got["value"]["severity"] == "critical" and got["value"]["p_value"] < 0.001
    assert got["category"]["severity"] == "critical"
    fresh = {(r["category"], r["status"]) for r in drift.new_and_removed(*sides, ["category"]).collect()}
    assert fresh == {("C", "new")}


def test_no_drift_with_itself(sides):
    a, _ = sides
    assert {r["severity"] for r in drift.detect_drift(a, a).collect()} == {"none"}


def test_too_few_rows(spark, sides):
    few = frame(spark, [1.0, 2.0], ["A", "B"])
    assert {r["test_used"] for r in drift.detect_drift(sides[0], few).collect()} == {"not enough rows"}


def test_constant_reference(spark, sides):
    one = frame(spark, [5.0] * 40, ["A"] * 40)
    rows = drift.detect_drift(one, sides[0], ["value"]).collect()
    assert rows[0]["has_drift"]


def test_forest_finds_planted_values(spark):
    values = list(np.random.default_rng(42).normal(100, 15, 100)) + [250.0, 300.0, -50.0, 350.0]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "k int, value double")
    forest = outliers.fit_forest(df, ["k"])
    rows = sorted((r["score"], r["k"]) for r in outliers.detect_outliers(df, forest, ["k"]).collect())
    assert {k for _, k in rows[:4]} == {100, 101, 102, 103} and 4 <= len(rows) <= 12
    again = outliers.fit_forest(df.repartition(7), ["k"])
    assert again.cuts == forest.cuts and np.array_equal(again.steps["value"][1], forest.steps["value"][1])
    with pytest.raises(ValueError):
        outliers.fit_forest(df, ["k"], contamination=0.5)


def test_forest_skips_short_and_survives_constant_columns(spark):
    df = spark.createDataFrame([(i, 1.0, float(i) if i < 5 else None) for i in range(40)], "k int, same double, short double")
    forest = outliers.fit_forest(df, ["k"])
    assert list(forest.steps) == ["same"]
    assert outliers.detect_outliers(df, forest, ["k"]).count() == 0


def test_kendall_and_spearman_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 12, 400), rng.integers(0, 9, 400)
    y = np.where(rng.random(400) < 0.5, x, y)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "x int, y int")
    dx, dy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    tau = (dx * dy).sum() / np.sqrt((dx ** 2).sum() * (dy ** 2).sum())
    assert correlation.kendall(df, "x", "y", slices=7).first()["correlation"] == pytest.approx(tau, abs=1e-12)
    want = df.toPandas().rank().corr().iloc[0, 1]
    assert correlation.spearman(df).first()["correlation"] == pytest.approx(want, abs=1e-12)


def test_hot_value_quantiles(spark):
    values = [7.0] * 700 + list(map(float, range(1000)))
    df = spark.createDataFrame([("c", v) for v in values], "column string, number double").groupBy("column", "number").count()
    got = quantiles(df, ["column"], [0, 0.1, 0.5, 0.99, 1], "number", "count", bits=3).first()["quantiles"]
    assert got == pytest.approx(list(np.quantile(values, [0, 0.1, 0.5, 0.99, 1])))


def test_positions(spark):
    df = spark.range(1000).selectExpr("id % 10 as a", "id as b")
    rows = positions(df, ["a", "b"], partitions=6).collect()
    assert [r["position"] for r in sorted(rows, key=lambda r: (r["a"], r["b"]))] == list(range(1000))
