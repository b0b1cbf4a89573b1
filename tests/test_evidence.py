"""Evidence behind issues, and columns that hold one value."""

import random

from pyspark.sql import functions as F

from plumbline.operators import checks, corrections, evidence, profile


def test_first_rows_of_many_conditions(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(60), rng.choice(["a", None, "b"]), rng.randrange(5)) for _ in range(400)]
    df = spark.createDataFrame(rows, "id int, word string, n int").repartition(7)
    conditions = {f"n{i}": (F.col("n") == i, F.col("word")) for i in range(5)} | {"never": (F.lit(None).cast("boolean"), F.col("word"))}
    got = {}
    for r in evidence.first_rows_of_each(df, ["id"], conditions, 9).orderBy("condition", "place").collect():
        got.setdefault(r["condition"], []).append((r["id"], r["value"]))
    for i in range(5):
        assert got[f"n{i}"] == sorted(((k, w) for k, w, n in rows if n == i), key=lambda x: (x[0], x[1] is not None, x[1] or ""))[:9]
    assert "never" not in got


def test_one_scan_for_all_columns(spark, tmp_path):
    wide = spark.range(50).select("id", *[(F.col("id") * i).alias(f"c{i}") for i in range(100)])
    wide.write.parquet(f"{tmp_path}/wide")
    rows = profile.sample_values(spark.read.parquet(f"{tmp_path}/wide"), ["id"], k=3)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "WindowGroupLimit" in plan
    assert rows.count() == 300 and rows.where("column = 'c7'").orderBy("_k0").first()["value"] == "0"


def test_evidence_of_issues(spark, dirty):
    issues = checks.column_issues(dirty)
    found = evidence.evidence(dirty, issues, ["id"], k=2)
    got = {}
    for r in found.orderBy("place").collect():
        got.setdefault((r["rule_id"], r["column"]), []).append((r["id"], r["value"]))
    assert got[("missing_values", "salary")] == [(2, None), (7, None)]
    assert got[("format", "email")] == [(4, "bad")]
    shown = {(r["rule_id"], r["column"]): r for r in evidence.with_evidence(issues, found, ["id"]).collect()}
    assert [k["id"] for k in shown[("missing_values", "salary")]["row_keys"]] == [2, 7] and shown[("format", "email")]["samples"] == ["bad"]
    assert len(shown) == issues.count()
    clean = dirty.select("id")
    assert evidence.evidence(clean, checks.column_issues(clean, ["missing_values"]), ["id"]).count() == 0


def test_constant_columns(spark):
    df = spark.range(30).select(F.lit(3.0).alias("x"), F.col("id").cast("double").alias("y"))
    assert {r["column"]: r["distribution_type"] for r in profile.shape(df).collect()}["x"] == "constant"
    made = corrections.apply(df, corrections.CorrectionPlan(standardize=["x", "y"])).collect()
    assert {r["x"] for r in made} == {0.0} and abs(sum(r["y"] for r in made)) < 1e-9
