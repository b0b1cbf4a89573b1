from pyspark.sql import functions as F

from plumbline.operators import corrections as R
from plumbline.operators import domains as D
from plumbline.operators import feedback as B
from plumbline.plans import analysis


def test_apply_median_mode_and_duplicates(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y"), (3.0, "x"), (None, "N/A"), (8.0, None), (1.0, "x")], "col_a double, col_b string")
    plan = R.plan_from_issues(analysis.find_issues(df), df)
    assert plan.drop_duplicates and plan.impute == {"col_a": "median", "col_b": "mode"}
    rows = R.apply(df, plan).collect()
    assert len(rows) == 5 and sorted(r["col_a"] for r in rows) == [1.0, 3.0, 3.0, 3.0, 8.0] and {r["col_b"] for r in rows} == {"x", "y"}


def test_trim_keeps_nulls(spark):
    df = spark.createDataFrame([(" a ",), (None,)], "v string")
    assert [r["v"] for r in R.apply(df, R.CorrectionPlan(trim=["v"])).collect()] == ["a", None]


def test_full_run(dirty):
    report = analysis.run(dirty, "full")
    kinds = {(r["column"], r["correction_type"]) for r in report.proposals.collect()}
    assert {("salary", "impute_median"), ("salary", "impute_mean"), ("name", "impute_mode"), ("id", "delete_row"), ("id", "manual_review"), ("salary", "clip_values")} <= kinds
    verdicts = {r["proposal_id"]: r for r in report.validations.collect()}
    dropped = report.proposals.where("correction_type = 'delete_row'").first()
    assert verdicts[dropped["proposal_id"]]["status"] == "rejected"  # 9 rows would remain
    assert report.improvement.first()["estimated_improvement"] > 0
    assert report.approved.count() == len(verdicts)


def test_presets(dirty):
    assert set(analysis.run(dirty, "profile").tables) == {"profile"}
    assert "proposals" not in analysis.run(dirty, "analyze").tables


def test_comparison_improves(dirty):
    corrected, tables = analysis.correct_and_compare(dirty)
    row = tables["scores"].first()
    assert row["score_after"] > row["score_before"] and corrected.where("salary is null").count() == 0
    assert "salary" in {r["column"] for r in tables["columns_improved"].collect()}


def test_adjustment_without_feedback_changes_nothing(dirty):
    report = analysis.run(dirty, "recommend")
    nothing = dirty.sparkSession.createDataFrame([], "correction_type string, confidence_adjustment double")
    before = {r["proposal_id"]: r["confidence"] for r in report.proposals.collect()}
    assert {r["proposal_id"]: r["confidence"] for r in R.adjust_from_feedback(report.proposals, nothing).collect()} == before


def test_key_duplicates_keep_first(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "k int, t int, v string")
    assert {(r["k"], r["v"]) for r in R.drop_duplicate_keys(df, ["k"], ["t"]).collect()} == {(1, "a"), (2, "c")}


def test_domain_tie_goes_to_the_first(spark):
    sem = spark.createDataFrame([("d", "a", "email"), ("d", "b", "age")], "dataset_id string, column string, semantic_type string")
    profiles = spark.createDataFrame(
        [("late", 2, 0.3, ["email"]), ("first", 1, 0.3, ["age"]), ("strict", 0, 1.0, ["age", "city"])],
        "domain_id string, created_at int, min_match_ratio double, trigger_types array<string>").withColumn("active", F.lit(True))
    assert D.detect_domain(sem, profiles).first()["domain_id"] == "first"


def test_feedback_factor_lowers_issue_confidence(spark, dirty):
    events = [(i, f"2024-01-01 00:{i:02d}:00", "issue", f"t{i}", False, None) for i in range(8)]
    fb = spark.createDataFrame(events, "feedback_id int, ts string, target_type string, target_id string, is_correct boolean, user_correction string").withColumn("ts", F.col("ts").cast("timestamp"))
    fold = B.confidence_fold(fb)
    row = fold.first()
    assert (row["confidence"], row["false_positives"], row["confirmations"]) == (0.85, 8, 0)
    issues = analysis.find_issues(dirty, checks=["missing_values"], duplicates=False)
    assert {round(r["confidence"], 4) for r in B.adjusted_issues(issues, fold).collect()} == {round(0.95 * 0.85, 4)}
