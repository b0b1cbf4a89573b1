"""Dates in text columns: the column as a whole settles its layout and the order of day and month.

05/06/2024 alone says nothing; a column that also holds 31/12/2024 is day first, one that holds
12/31/2024 month first. All counts are one aggregate, a row per column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import predicates as P

c = F.col
COLUMNS_PER_SCAN = 32  # wider tables are read in slices, to keep generated code small
SHAPES = {"iso": P.ISO_DATE, "year_first": P.YEAR_FIRST, "compact": P.COMPACT, "month_name_first": P.NAMED_MONTH_FIRST, "day_month_name": P.NAMED_DAY_FIRST, "numeric": P.DAY_MONTH}


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if P.is_text(f.dataType)]


def date_layouts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row per text column: (column, n_values, n_<shape>..., n_day_sure, n_month_sure, day_first, n_dates, date_share, layout).

    n_day_sure counts cells that are a date with the day first only, n_month_sure those with the month first only;
    the column is day first unless the latter are more. n_dates counts what is a date in that order; ``layout`` is the most
    frequent shape of it, null for a column without dates. Blank cells are values that are no dates, nulls no values.
    """
    columns = list(columns if columns is not None else text_columns(df))
    if not columns:
        shapes = ", ".join(f"n_{x} bigint" for x in SHAPES)
        return df.sparkSession.createDataFrame([], f"column string, n_values bigint, {shapes}, n_day_sure bigint, n_month_sure bigint, day_first boolean, n_dates bigint, date_share double, layout string")
    if len(columns) > COLUMNS_PER_SCAN:
        slices = [date_layouts(df, columns[i:i + COLUMNS_PER_SCAN]) for i in range(0, len(columns), COLUMNS_PER_SCAN)]
        return reduce(DataFrame.unionByName, slices)
    cells, dates, sums, rows = [], [], [], []
    for i, name in enumerate(columns):
        s = f"__s{i}"
        cells.append(f"{P.strip(P.quoted(name))} as {s}")
        shape = " ".join(f"when {P.matches(f'lower({s})' if k.endswith(('first', 'name')) and k != 'year_first' else s, p)} then '{k}'" for k, p in SHAPES.items())
        dates += [
            f"case when char_length({s}) > {P.LONGEST_DATE} then null {shape} end as __k{i}", f"{P.plain_date_of(s)} is not null as __p{i}",
            f"{P.numeric_date_of(s, True)} is not null as __d{i}", f"{P.numeric_date_of(s, False)} is not null as __m{i}",
        ]
        sums += [
            f"count({s}) as `{i}_values`", f"count_if(__p{i}) as `{i}_plain`", f"count_if(__d{i}) as `{i}_day`", f"count_if(__m{i}) as `{i}_month`",
            f"count_if(__d{i} and not __m{i}) as `{i}_day_sure`", f"count_if(__m{i} and not __d{i}) as `{i}_month_sure`",
            *[f"count_if(__k{i} = '{k}') as `{i}_{k}`" for k in SHAPES],
        ]
        order = f"`{i}_day_sure` >= `{i}_month_sure`"
        fields = [f"{P.literal(name)} as column", f"`{i}_values` as n_values", *[f"`{i}_{k}` as n_{k}" for k in SHAPES],
                  f"`{i}_day_sure` as n_day_sure", f"`{i}_month_sure` as n_month_sure", f"{order} as day_first",
                  f"`{i}_plain` + if({order}, `{i}_day`, `{i}_month`) as n_dates"]
        rows.append(f"struct({', '.join(fields)})")
    out = df.selectExpr(*cells).selectExpr("*", *dates).selectExpr(*sums).selectExpr(f"inline(array({', '.join(rows)}))")
    most = F.greatest(*[c(f"n_{k}") for k in SHAPES])
    layout = F.coalesce(*[
        F.when(c(f"n_{k}") == most, F.lit(k) if k != "numeric" else F.when(c("day_first"), "day_first").otherwise("month_first")) for k in SHAPES
    ])
    share = F.when(c("n_values") > 0, c("n_dates") / c("n_values")).otherwise(0.0)
    return out.select("*", share.alias("date_share"), F.when(c("n_dates") > 0, layout).alias("layout"))


def parse_dates(df: DataFrame, columns: Sequence[str] | None = None, least: float = 0.7, layouts: DataFrame | None = None) -> DataFrame:
    """``df`` with its text columns of dates read as dates, each in its own order; cells that are none become null.

    Only columns of which a share of ``least`` are dates change, listed ones always. ``layouts`` may come from another table,
    say the month before; else one scan finds them. What is read on the driver is a row per column.
    """
    found = {r["column"]: r for r in (layouts if layouts is not None else date_layouts(df, columns)).collect()}
    out = []
    for name in df.columns:
        raw = P.quoted(name)
        row = found.get(name)
        if row is None or not P.is_text(df.schema[name].dataType) or (columns is None and row["date_share"] < least) or (columns is not None and name not in columns):
            out.append(raw)
        else:
            s = P.strip(raw)
            out.append(f"coalesce({P.plain_date_of(s)}, {P.numeric_date_of(s, row['day_first'])}) as {raw}")
    return df.selectExpr(*out)
