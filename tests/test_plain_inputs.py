"""Everyday inputs that a clean sample table does not hold: dead and constant columns, JSON lines, names of any script."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import predicates as P
from plumbline.operators import correlation, drift, profile, rules
from plumbline.sources import readers


@pytest.fixture(scope="module")
def plain(spark):
    return spark.range(200).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"), F.lit(0.1).alias("fixed"), F.concat(F.lit("c"), F.col("id") % 3).alias("word"))


def test_drift_survives_dead_columns(plain):
    dead = plain.withColumns({"x": F.lit(None).cast("double"), "word": F.lit(None).cast("string")})
    for reference, current in ((plain, dead), (dead, plain), (dead, dead)):
        got = {r["column"]: r for r in drift.detect_drift(reference, current).collect()}
        assert set(got) == {"x", "y", "fixed", "word"}
        assert all(got[k]["test_used"] == "not enough rows" and not got[k]["has_drift"] and got[k]["severity"] == "none" for k in ("x", "word"))
        assert got["y"]["test_used"] == "KS-test + PSI" and not got["y"]["has_drift"]


def test_drift_reports_a_change_of_type(plain):
    got = {r["column"]: r for r in drift.detect_drift(plain, plain.withColumn("x", F.concat(F.lit("n"), "x"))).collect()}
    assert got["x"]["test_used"] == "type change" and got["x"]["has_drift"]


def test_correlation_with_a_constant_is_null(plain):
    for made in (correlation.pearson(plain, ["x", "y", "fixed"]), correlation.spearman(plain, ["x", "y", "fixed"])):
        got = {(r["column_1"], r["column_2"]): r["correlation"] for r in made.collect()}
        assert got["x", "fixed"] is None and got["y", "fixed"] is None and got["x", "y"] is not None
    assert correlation.kendall(plain, "x", "fixed").first()["correlation"] is None


def test_constant_column_has_no_far_rows(plain):
    assert rules.beyond_deviations(plain.repartition(4), "fixed", ["x"]).count() == 0


def test_content_hash_sees_where_a_null_is(spark):
    schema = "a int, b int"
    one, two = (profile.content_hash(spark.createDataFrame(rows, schema)).first() for rows in ([(1, None)], [(None, 1)]))
    assert one["row_hash"] != two["row_hash"]


def test_json_lines_and_documents(spark, tmp_path):
    spark.range(100).write.json(str(tmp_path / "lines.json"))
    assert readers.read_table(spark, str(tmp_path / "lines.json")).count() == 100
    (tmp_path / "document.json").write_text('[\n {"a": 1},\n {"a": 2}\n]\n')
    assert readers.read_table(spark, str(tmp_path / "document.json")).count() == 2


def test_literal_beyond_the_basic_plane(spark):
    assert spark.range(1).select(P.col(P.literal("a😀'b")).alias("s")).first()["s"] == "a😀'b"


def test_rule_of_an_unknown_kind_is_an_error(spark):
    table = spark.createDataFrame([("r1", "t", "constraint", "low", "general", True, "cardinality", None)], "rule_id string, text string, rule_type string, severity string, category string, active boolean, kind string, params map<string,string>")
    with pytest.raises(ValueError, match="cardinality"):
        rules.bind_rules(table, {"r1": ["x"]})


def test_near_duplicates_count_every_partner_once(spark):
    rows = [("a", "b", "c", "d"), ("a", "b", "c", "z"), ("y", "b", "c", "d"), ("q", "q", "q", "q"), ("n", None, "m", None), ("n", None, "m", "o"), ("n", None, "m", "o")]
    table = spark.createDataFrame([(1, *r) for r in rows], "block int, p string, q string, r string, s string")
    for ratio in (0.25, 0.5, 0.75, 1.0):
        got = {tuple(r)[1:5]: r["partners"] for r in rules.near_duplicates(table, ["block"], ["p", "q", "r", "s"], ratio).collect()}
        agreeing = {r: sum(sum(x == y for x, y in zip(r, o, strict=True)) >= 4 * ratio for o in rows) - 1 for r in rows}
        assert got == {r: n for r, n in agreeing.items() if n}


def test_near_duplicates_of_one_wide_row(spark):
    wide = spark.range(1).select(*[F.lit(i).alias(f"c{i}") for i in range(50)])
    assert rules.near_duplicates(wide, [], wide.columns, 0.9).count() == 0
    assert [tuple(r)[-2:] for r in rules.near_duplicates(wide.unionByName(wide), [], wide.columns, 0.9).collect()] == [(2, 1)]
    with pytest.raises(ValueError, match="at least one"):
        rules.near_duplicates(wide, [], wide.columns[:3], 0.0)


def test_limits_on_a_text_column(spark):
    rule_rows = [("low", "t", "constraint", "low", "general", True, "min", {"limit": "0"}), ("band", "t", "constraint", "low", "general", True, "range", {"low": "-10", "high": "1e6"})]
    table = spark.createDataFrame(rule_rows, "rule_id string, text string, rule_type string, severity string, category string, active boolean, kind string, params map<string,string>")
    values = spark.createDataFrame([("abc", 1.0), ("-3", -3.0), ("-11", 1e300), (None, None), (" 7 ", -0.5)], "word string, x double")
    for column, low, band in (("word", 2, 1), ("x", 2, 1)):
        made = rules.bind_rules(table, {"low": [column], "band": [column]})
        got = {r["rule_id"]: r["violations"] for r in rules.count_violations(values, {k: v[0] for k, v in made.items()}).collect()}
        assert got == {f"low:{column}": low, f"band:{column}": band}
