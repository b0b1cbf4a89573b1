"""Date layouts settled by the column."""

import datetime

from plumbline.functions import predicates as P
from plumbline.operators import datelayouts, semantic
from plumbline.operators import profile as prof

D = datetime.date


def test_layouts_of_single_cells(spark):
    want = {
        "20240105": D(2024, 1, 5), "Jan 5, 2024": D(2024, 1, 5), "2024-01-05T10:00:00+02:00": D(2024, 1, 5), "2024-01-05 10:00:00.123456789-0530": D(2024, 1, 5),
        "5 January 2024": D(2024, 1, 5), "05-SEP-2024": D(2024, 9, 5), "sept. 5 2024": D(2024, 9, 5), "20240105T101530Z": D(2024, 1, 5), "May 31, 2024": D(2024, 5, 31),
        "20241305": None, "30000105": None, "Feb 30, 2024": None, "Janu 5, 2024": None, "5 Mayor 2024": None, "2024-01-05T10:00:00+2": None, "x" * 500: None, "": None, None: None,
    }
    df = spark.createDataFrame([(x,) for x in want], "v string").selectExpr("v", f"{P.to_date('v')} as d")
    assert {r["v"]: r["d"] for r in df.collect()} == want


def test_the_column_settles_the_order(spark):
    rows = [("12/31/2023", "31/12/2023", "05/06/2024", None), ("05/06/2024", "05/06/2024", "01/02/2024", None), ("31/12/2023", "12/31/2023", "", None), ("1/13/2024", "13.1.2024", "no", None)]
    df = spark.createDataFrame(rows, "us string, eu string, `o.pen` string, none string")
    found = {r["column"]: r for r in datelayouts.date_layouts(df).collect()}
    assert [(found[x]["day_first"], found[x]["n_dates"], found[x]["layout"]) for x in ("us", "eu", "o.pen", "none")] == [
        (False, 3, "month_first"), (True, 3, "day_first"), (True, 2, "day_first"), (True, 0, None)]
    got = datelayouts.parse_dates(df, ["us", "eu"]).collect()
    assert [r["us"] for r in got] == [D(2023, 12, 31), D(2024, 5, 6), None, D(2024, 1, 13)]
    assert [r["eu"] for r in got] == [D(2023, 12, 31), D(2024, 6, 5), None, D(2024, 1, 13)]
    untouched = datelayouts.parse_dates(df)
    assert dict(untouched.dtypes) == {"us": "date", "eu": "date", "o.pen": "string", "none": "string"}


def test_tables_without_texts_or_rows(spark):
    assert datelayouts.date_layouts(spark.range(3)).count() == 0
    empty = datelayouts.date_layouts(spark.createDataFrame([], "a string")).first()
    assert (empty["n_dates"], empty["date_share"], empty["layout"]) == (0, 0.0, None)


def test_types_see_the_layouts(spark):
    df = spark.createDataFrame([(f"2024{1 + i % 12:02d}{1 + i % 28:02d}", f"Mar {1 + i % 28}, {1950 + i}") for i in range(100)], "a string, b string")
    assert {r["column"]: r["semantic_type"] for r in semantic.semantic_types(df).collect()} == {"a": "date_string", "b": "date_string"}
    assert {r["column"]: r["inferred_type"] for r in prof.profile(df).collect()}["b"] == "datetime_string"
