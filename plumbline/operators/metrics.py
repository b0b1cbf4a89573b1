"""Column metrics: every count and moment the checks need, in one aggregate over one scan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import constants as K
from plumbline.functions import predicates as P
from plumbline.functions.expressions import small
from plumbline.operators.frequencies import distinct_counts, plain_columns, value_frequencies

COUNTS = [
    "n_rows", "n_values", "n_pseudo", "n_number", "n_date", "n_boolean", "n_email", "n_phone",
    "n_url", "n_postal", "n_siret", "n_siren", "n_ip", "n_exact_email", "n_exact_phone", "n_exact_url",
    "n_exact_postal", "n_blank", "n_corrupt",
    "n_negative", "n_off_percent", "n_off_age", "n_in_range", "n_true", "size_bytes",
]
MOMENTS = ["mean", "std", "min", "max", "skewness", "kurtosis", "avg_length"]
ALL = COUNTS + MOMENTS

BASIC = ["n_rows", "n_values"]
NUMERIC = ["mean", "std", "min", "max"]
TEXT_SHARES = [
    "n_pseudo", "n_number", "n_date", "n_boolean", "n_email", "n_phone", "n_url", "n_postal",
    "n_siret", "n_siren", "n_ip", "n_exact_email", "n_exact_phone", "n_exact_url", "n_exact_postal",
]
RANGES = ["n_negative", "n_off_percent", "n_off_age", "n_in_range"]

COLUMNS_PER_SCAN = 64  # wider tables are read in slices of columns, to keep generated code small


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, P.INTEGRAL):
        return "integer"
    if P.is_numeric(dtype):
        return "float"
    if isinstance(dtype, P.TEMPORAL):
        return "datetime"
    return "text" if P.is_text(dtype) else "other"


@dataclass
class _Plan:
    """SQL text for one column: what is computed once per cell, then what is aggregated."""

    stripped: dict[str, str] = field(default_factory=dict)
    cells: dict[str, str] = field(default_factory=dict)
    aggregates: dict[str, str] = field(default_factory=dict)


def _plan(i: int, name: str, dtype: T.DataType, wanted: set[str]) -> _Plan:
    """Text cells are stripped once, and each pattern is matched once, whatever is counted from it."""
    raw = P.quoted(name)
    v = P.present(raw, dtype)
    kind = kind_of(dtype)
    plan = _Plan(aggregates={"n_values": f"count({v})"})
    out = plan.aggregates

    def want(metric: str, aggregate: str) -> None:
        if metric in wanted:
            out[metric] = aggregate

    def count_if(metric: str, condition: str) -> None:
        want(metric, f"count_if({condition})")

    number = None
    count_if("n_blank", f"{v} is null")
    if kind in ("integer", "float"):
        number = P.as_double(name, dtype)
        want("mean", f"avg({number})")
        want("std", f"stddev_samp({number})")
        for m in ("min", "max", "skewness", "kurtosis"):
            want(m, f"{m}({number})")
    elif kind == "text":
        s, number = f"__s{i}", f"__x{i}"
        if wanted & set(TEXT_SHARES + RANGES + ["n_blank"]):
            plan.stripped[s] = P.strip(raw)
        if wanted & set(RANGES + ["n_number"]):
            plan.cells[number] = P.number_of(s)
        want("avg_length", f"avg(char_length({raw}))")
        want("n_number", f"count({number})")
        count_if("n_pseudo", P.pseudo_null_of(s))
        count_if("n_boolean", P.boolean_of(s))
        count_if("n_date", f"{P.date_of(s)} is not null")
        count_if("n_blank", f"{raw} is null or {s} = ''")
        count_if("n_corrupt", P.is_corrupt_text(raw))
        own = P.format_of_name(name)
        for f in ("email", "phone", "url", "postal", "ip", *([own] if own in ("siret", "siren") else [])):
            if wanted & {f"n_{f}", f"n_exact_{f}"}:
                plan.cells[f"__{f}{i}"] = P.matches(s, K.FORMATS[f])
                count_if(f"n_{f}", f"__{f}{i}")
                if f"n_exact_{f}" in COUNTS:
                    count_if(f"n_exact_{f}", f"__{f}{i} and {s} = {raw}")
    elif kind == "boolean":
        count_if("n_true", raw)
    if number is not None:
        count_if("n_negative", f"{number} < 0")
        count_if("n_off_percent", f"{number} < 0 or {number} > 100")
        count_if("n_off_age", f"{number} < 0 or {number} > 150")
        bounds = K.SEMANTIC_RANGES.get(P.semantic_of_name(name) or "")
        if bounds:
            count_if("n_in_range", f"{number} between {bounds[0]}D and {bounds[1]}D")
    if kind == "text":
        want("size_bytes", f"coalesce(sum(octet_length({raw})), 0)")
    else:
        width = {"boolean": 1, "datetime": 8}.get(kind, 4 if isinstance(dtype, (T.IntegerType, T.FloatType)) else 8)
        want("size_bytes", f"count({v}) * {width}")
    return plan


def column_metrics(df: DataFrame, columns: Sequence[str] | None = None, metrics: Iterable[str] = ALL) -> DataFrame:
    """One row per column with the wanted ``metrics`` (the others null), from one scan."""
    columns = list(columns or plain_columns(df))
    wanted = set(metrics) | {"n_rows", "n_values"}
    slices = [columns[i:i + COLUMNS_PER_SCAN] for i in range(0, len(columns), COLUMNS_PER_SCAN)]
    parts = [_metrics_slice(df, part, wanted, columns.index(part[0])) for part in slices]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _metrics_slice(df: DataFrame, columns: Sequence[str], wanted: set[str], first: int) -> DataFrame:
    aggregates, rows, stripped, cells = ["count(1) as n_rows"], [], [], []
    for i, name in enumerate(columns):
        dtype = df.schema[name].dataType

        def text(value: str | None) -> str:
            return P.literal(value) if value else "cast(null as string)"

        fields = [
            f"{first + i} as ordinal", f"{P.literal(name)} as column", f"{P.literal(dtype.simpleString())} as dtype",
            f"{P.literal(kind_of(dtype))} as kind", f"{text(P.format_of_name(name))} as name_format",
            f"{text(P.semantic_of_name(name))} as name_type", f"{P.is_identifier_name(name)} as name_is_id",
            f"{name.lower() == 'id' or name.lower().endswith('_id')} as name_ends_id",
        ]
        plan = _plan(i, name, dtype, wanted)
        expressions = plan.aggregates
        stripped += [f"{e} as {k}" for k, e in plan.stripped.items()]
        cells += [f"{e} as {k}" for k, e in plan.cells.items()]
        for metric in ALL:
            value = "null"
            if metric == "n_rows":
                value = "n_rows"
            elif metric in expressions:
                aggregates.append(f"{expressions[metric]} as `{i}_{metric}`")
                value = f"`{i}_{metric}`"
            fields.append(f"cast({value} as {'bigint' if metric in COUNTS else 'double'}) as {metric}")
        rows.append(f"struct({', '.join(fields)})")
    for stage in (stripped, cells):
        if stage:
            df = df.selectExpr("*", *stage)
    # one row, unfolded to one row per column
    return df.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(rows)}))")


def with_distinct(metrics: DataFrame, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Adds the exact number of distinct non-null values per column."""
    freq = value_frequencies(df, columns, digest_over=64)
    counts = distinct_counts(freq).select("column", "n_distinct")
    return metrics.join(small(counts), "column", "left").withColumn(
        "n_distinct", F.coalesce("n_distinct", F.lit(0).cast("bigint"))
    )
