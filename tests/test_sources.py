from pathlib import Path

import pytest

from plumbline.operators import history, rules
from plumbline.plans import analysis
from plumbline.sources import readers, writers

CATALOGUE = str(Path(history.__file__).parent.parent / "data" / "default_rules.json")


def test_csv_variants(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    (tmp_path / "b.csv").write_bytes("id;name\n1;été\n2;y\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes("﻿id\tname\n1\tx\n".encode("utf-8"))
    assert readers.sniff_csv(spark, str(tmp_path / "a.csv")) == {"sep": ",", "encoding": "UTF-8"}
    assert readers.sniff_csv(spark, str(tmp_path / "b.csv")) == {"sep": ";", "encoding": "ISO-8859-1"}
    assert [r["name"] for r in readers.read_table(spark, str(tmp_path / "b.csv")).orderBy("id").collect()] == ["été", "y"]
    assert readers.read_table(spark, str(tmp_path / "c.csv")).columns == ["id", "name"]


def test_json_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]')
    assert sorted(r["a"] for r in readers.read_table(spark, str(tmp_path / "a.json")).collect()) == [1, 2]
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.xlsx")


def test_guards(spark):
    with pytest.raises(readers.EmptyTable):
        readers.check_size(spark.range(0))
    with pytest.raises(readers.TooManyRows):
        readers.check_size(spark.range(11), 10)
    assert readers.check_size(spark.range(10), 10).count() == 10


def test_sample_is_exact_and_repeatable(spark):
    a, b = (sorted(r["id"] for r in readers.sample_rows(spark.range(1000).repartition(n), ["id"], 100).collect()) for n in (2, 9))
    assert a == b and len(a) == 100


def test_sessions_and_reports(spark, dirty, tmp_path):
    report = analysis.run(dirty, "analyze", dataset_id="d")
    path = str(tmp_path / "store")
    writers.save_session_input(dirty, path, "s1")
    assert writers.load_session_input(spark, path, "s1").count() == 10
    writers.save_results({"issues": report.issues}, path, "s1")
    assert writers.load_results(spark, path, "s1", ["issues"])["issues"].count() == report.issues.count()
    tables = writers.report_tables(report.totals, report.issues, report.profile, report.column_scores, report.score)
    assert set(tables) == {"summary", "issues", "columns", "column_scores"}
    writers.write_report(tables, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report" / "columns")).count() == 5
    history.record_session(report.issues, report.score, "s1", "2024-01-01 00:00:00", f"{path}/sessions")
    row = spark.read.parquet(f"{path}/sessions").first()
    assert row["issues_count"] == report.issues.count() and row["top_columns"] == sorted(row["top_columns"])


def test_dataset_identity_ignores_rows_and_order(spark, dirty):
    assert history.dataset_id(dirty) == history.dataset_id(dirty.limit(1).select(*reversed(dirty.columns)))
    assert history.dataset_id(dirty) != history.dataset_id(dirty.drop("age"))


def test_default_rules(spark, dirty):
    catalogue = readers.load_rules(spark, CATALOGUE)
    assert catalogue.count() == 15 and catalogue.where("severity = 'critical'").count() == 3
    assert rules.active_rules(catalogue, "format").count() == 3
    bound = rules.bind_rules(catalogue, {"age_span": ["age"], "amount_floor": ["salary"], "required_fields": ["name"], "email_shape": ["email"]})
    got = {r["rule_id"]: r["affected_count"] for r in rules.predicate_issues(dirty, bound).collect()}
    assert got == {"age_span:age": 2, "amount_floor:salary": 1, "required_fields:name": 3, "email_shape:email": 1}


def test_rules_steer_the_checks(spark, dirty):
    table = spark.createDataFrame([("r1", "column id constraint validation rule: unique", "constraint", "critical", "uniqueness", True),
                                   ("r2", "column salary constraint validation rule: not null", "constraint", "high", "completeness", True)],
                                  "rule_id string, text string, rule_type string, severity string, category string, active boolean")
    got = {(r["rule_id"], r["column"]) for r in analysis.find_issues(dirty, rule_table=table).collect()}
    assert ("r1", "id") in got and ("r2", "salary") in got


def test_batch_isolates_bad_files(spark, tmp_path):
    (tmp_path / "good.csv").write_text("id,value,label\n" + "\n".join(f"{i},{i * 1.5},l{i}" for i in range(20)))
    (tmp_path / "empty.csv").write_text("id,value\n")
    rows = {r["filename"]: r for r in analysis.analyze_files(spark, [str(tmp_path / n) for n in ("good.csv", "empty.csv", "none.parquet", "odd.xyz")]).collect()}
    assert rows["good.csv"]["status"] == "success" and rows["good.csv"]["quality_score"] == 100.0
    assert {rows[n]["status"] for n in ("empty.csv", "none.parquet", "odd.xyz")} == {"error"}
