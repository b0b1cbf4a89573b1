"""Dates in text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.catalog.fixtures import as_sql, derive, table
from plumbline.catalog.profiling import numeric_date, over, plain_date, union
from plumbline.operators import datelayouts

Y, M, D = (f"concat('', {part}(o_orderdate))" for part in ("year", "month", "day"))
MM, DD = f"lpad({M}, 2, '0')", f"lpad({D}, 2, '0')"
NAME = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * month(o_orderdate) - 2 AS INT), 3)"
DATE_TEXTS = {
    "o_orderkey": "o_orderkey",
    "american": f"concat({M}, '/', {D}, '/', {Y})", "european": f"concat({DD}, '.', {MM}, '.', {Y})",
    "compact": f"concat({Y}, {MM}, {DD})", "named": f"concat({NAME}, ' ', {D}, ', ', {Y})", "day_named": f"concat({D}, '-', {NAME}, '-', {Y})",
    "offset_time": f"concat({Y}, '-', {MM}, '-', {DD}, 'T10:00:00+02:00')", "slashed": f"concat(' ', {Y}, '/', {M}, '/', {D})",
    "mixed": f"CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'soon' WHEN 2 THEN concat({Y}, '-02-30') WHEN 3 THEN concat({DD}, '/', {MM}, '/', {Y}) ELSE concat({MM}, '/', {DD}, '/', {Y}) END",
    "status": "o_orderstatus", "number": "concat('', 10000000 + o_orderkey)",
}
TEXTS = [x for x in DATE_TEXTS if x != "o_orderkey"]
TEXTS_SQL = as_sql(DATE_TEXTS, "orders")


def _layout_sql(x: str) -> str:
    day, month = numeric_date(x, True), numeric_date(x, False)
    return f"""SELECT '{x}' AS "column", n_values, n_day_sure, n_month_sure, n_day_sure >= n_month_sure AS day_first, plain + CASE WHEN n_day_sure >= n_month_sure THEN as_day ELSE as_month END AS n_dates FROM (
  SELECT count({x}) AS n_values, count({plain_date(x)}) AS plain, count({day}) AS as_day, count({month}) AS as_month,
  count(*) FILTER (WHERE {day} IS NOT NULL AND {month} IS NULL) AS n_day_sure, count(*) FILTER (WHERE {day} IS NULL AND {month} IS NOT NULL) AS n_month_sure FROM t)"""


@query(over(TEXTS_SQL, union([_layout_sql(x) for x in TEXTS])))
def date_layouts(spark, folder):
    rows = datelayouts.date_layouts(derive(table(spark, folder, "orders"), DATE_TEXTS))
    return rows.select("column", "n_values", "n_day_sure", "n_month_sure", "day_first", "n_dates")


_SAME = ", ".join(f"CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS {x}" for x in TEXTS[:7])


@query(f"SELECT o_orderkey, {_SAME} FROM orders")
def dates_read_from_text(spark, folder):
    """Seven layouts of the same date: each column, read in its own layout, gives the date back."""
    rows = derive(table(spark, folder, "orders"), DATE_TEXTS).select("o_orderkey", *TEXTS[:7])
    return datelayouts.parse_dates(rows).select("o_orderkey", *[F.col(x).cast("date").cast("string").alias(x) for x in TEXTS[:7]])
