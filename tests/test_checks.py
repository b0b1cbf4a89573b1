import random

from plumbline.operators import checks as C
from plumbline.operators import metrics, profile, scoring, semantic
from plumbline.plans import analysis


def found(rows):
    return {(r["rule_id"], r["column"]): r for r in rows.collect()}


def test_dirty_frame(dirty):
    got = found(analysis.find_issues(dirty))
    assert got["missing_values", "name"]["severity"] == "medium" and got["missing_values", "name"]["affected_count"] == 2
    assert got["missing_values", "salary"]["affected_percentage"] == 20.0
    assert got["unique_identifier", "id"]["affected_count"] == 1
    assert got["format", "email"]["affected_percentage"] == 10.0
    assert got["negative_amount", "salary"]["affected_count"] == 1
    # 80 % of the ages are in range, so the type rests on the name alone (confidence 0.62)
    assert got["age_range", "age"]["affected_count"] == 2
    assert ("age_range", "age") not in found(analysis.find_issues(dirty, min_confidence=0.7))
    assert not any(k[0] == "duplicate_rows" for k in got)


def test_clean_frame(spark):
    rows = [(i, f"p{i}", 20 + i, 50000 + i) for i in range(20)]
    df = spark.createDataFrame(rows, "customer_id bigint, name string, age bigint, salary bigint")
    report = analysis.run(df, "analyze")
    assert report.issues.count() == 0 and report.score.first()["score"] == 100.0


def test_missing_levels(spark):
    rows = [(None if i < 35 else i, None if i < 15 else i, None if i < 1 else i, i) for i in range(101)]
    got = found(C.column_issues(spark.createDataFrame(rows, "a int, b int, c int, d int"), ["missing_values"]))
    assert {k[1]: r["severity"] for k, r in got.items()} == {"a": "high", "b": "medium"}  # 1 of 101 is under 1 %


def test_pseudo_null_levels(spark):
    rows = [("N/A" if i < 4 else "x", "nd" if i < 2 else "x", "-" if i < 1 else "x") for i in range(10)]
    got = found(C.column_issues(spark.createDataFrame(rows, "a string, b string, c string"), ["pseudo_nulls"]))
    assert {k[1]: r["severity"] for k, r in got.items()} == {"a": "high", "b": "medium", "c": "low"}


def test_duplicates_count_all_copies(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x"), (3, "y")], "a int, b string")
    row = C.duplicate_counts(df).first()
    assert (row["duplicate_count"], row["groups"], row["row_count"]) == (3, 1, 5)
    issue = C.duplicate_rows(df).first()
    assert issue["details"]["unique_rows"] == "3" and issue["severity"] == "high"


def test_identifier_counts_nulls_as_one_value(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "user_id int")
    assert found(C.column_issues(df, ["unique_identifier"]))["unique_identifier", "user_id"]["affected_count"] == 2


def test_semantic_frame(spark):
    rows = [(f"a{i}@x.org", 20 + i, -5.0 if i == 0 else 10.0, 3.5, "A") for i in range(5)]
    df = spark.createDataFrame(rows, "email_client string, age_client int, ca_montant double, note_rating double, categorie string")
    got = {r["column"]: (r["semantic_type"], r["confidence"]) for r in semantic.semantic_types(df).collect()}
    assert got == {"email_client": ("email", 0.65), "age_client": ("age", 0.75), "ca_montant": ("monetary_amount", 0.62), "note_rating": ("rating", 0.75), "categorie": ("category", 0.62)}


def test_percentage_and_age_ranges(spark):
    df = spark.createDataFrame([(float(i), i) for i in range(20)] + [(150.0, 200)], "taux_completion double, age int")
    got = found(C.column_issues(df))
    assert got["percentage_range", "taux_completion"]["affected_count"] == 1 and got["age_range", "age"]["affected_count"] == 1


def test_wide_table(spark):
    df = spark.createDataFrame([tuple(range(i, i + 110)) for i in range(20)], ", ".join(f"col_{i} int" for i in range(110)))
    rows = metrics.column_metrics(df, None, ["mean", "max"]).collect()
    assert len(rows) == 110 and {r["column"]: r["max"] for r in rows}["col_109"] == 128.0
    assert [r["ordinal"] for r in rows] == list(range(110))


def test_result_does_not_depend_on_partitions(spark, dirty):
    one, many = (sorted(map(str, analysis.find_issues(dirty.repartition(n)).drop("details").collect())) for n in (1, 16))
    assert one == many
    moments = {"mean": 9, "std": 9}  # sums in another order differ in the last digit
    a, b = (
        sorted(str({k: round(v, moments[k]) if k in moments and v is not None else v for k, v in r.asDict().items()}) for r in profile.profile(dirty.repartition(n)).collect())
        for n in (1, 16)
    )
    assert a == b
    assert profile.content_hash(dirty.repartition(1)).first() == profile.content_hash(dirty.repartition(16)).first()


def test_infinite_and_empty(spark):
    df = spark.createDataFrame([], "a int, b string")
    rows = {r["column"]: r for r in profile.profile(df).collect()}
    assert rows["a"]["count"] == 0 and rows["b"]["inferred_type"] == "empty" and rows["a"]["q50"] is None
    assert C.column_issues(df).count() == 0


def test_quartiles_match_pandas(spark):
    random.seed(7)
    values = [random.choice([random.gauss(0, 1), 1.0, None, float("nan")]) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = profile.profile(df).first()
    want = df.toPandas()["v"].describe()
    assert [got["q25"], got["q50"], got["q75"]] == [want["25%"], want["50%"], want["75%"]] and got["count"] == want["count"]


def test_scores_and_counts(dirty):
    issues = analysis.find_issues(dirty, dataset_id="d")
    scores = {r["column"]: r["score"] for r in scoring.column_scores(analysis.columns_of(dirty, "d"), issues).collect()}
    assert scores["age"] == 88.0 and scores["id"] == 75.0 and scores["name"] == 88.0
    total = scoring.issue_counts(issues).where("severity is null and issue_type is null").first()["n"]
    assert total == issues.count()
