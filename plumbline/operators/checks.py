"""Quality checks. A check turns the metrics of a column into an issue, or into nothing.

All column checks are expressions over the same metrics row, so any set of them costs one scan
(two when a distinct count is needed). Each check can be used alone or added to ``CHECKS``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import constants as K
from plumbline.functions import predicates as P
from plumbline.functions.expressions import bands, percent, small
from plumbline.operators import metrics as M
from plumbline.operators.evidence import first_rows_of_each
from plumbline.operators.frequencies import plain_columns, top_values, value_frequencies
from plumbline.operators.semantic import SEMANTIC_METRICS, classification

ISSUE_COLUMNS = [
    "dataset_id", "issue_id", "issue_type", "severity", "column", "rule_id", "description",
    "details", "affected_count", "affected_percentage", "confidence", "needs_escalation",
]
c = F.col


def details(**values: Column | str) -> Column:
    """A map of strings; null entries are left out."""
    pairs = [
        F.struct(F.lit(k).alias("key"), (v if isinstance(v, Column) else F.lit(v)).cast("string").alias("value"))
        for k, v in values.items()
    ]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"].isNotNull()))


def issue(rule_id: str | Column, issue_type: str, severity: Column | str, count: Column, percentage: Column,
          confidence: float | Column, description: Column, info: Column | None = None) -> Column:
    def col(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(
        col(issue_type).alias("issue_type"), col(severity).alias("severity"), col(rule_id).alias("rule_id"),
        description.alias("description"), (info if info is not None else details()).alias("details"),
        count.cast("bigint").alias("affected_count"), percentage.cast("double").alias("affected_percentage"),
        col(confidence).cast("double").alias("confidence"),
    )


def finish(rows: DataFrame, dataset_id: str = "table") -> DataFrame:
    """Adds the dataset, a repeatable issue id and the escalation mark to issue rows."""
    dataset = c("dataset_id") if "dataset_id" in rows.columns else F.lit(dataset_id)
    return rows.select(
        dataset.alias("dataset_id"),
        F.sha2(F.concat_ws("|", dataset, "issue_type", F.coalesce("column", F.lit("")), "rule_id"), 256).substr(1, 16).alias("issue_id"),
        "issue_type", "severity", "column", "rule_id", "description", "details",
        "affected_count", "affected_percentage", "confidence",
        ((c("severity") == "critical") | (c("confidence") < 0.7)).alias("needs_escalation"),
    )


# Column checks

def missing_values(options: dict) -> Column:
    """Share of nulls. An override of the threshold replaces all three levels, so it gives high or nothing."""
    n = c("n_rows") - c("n_values")
    share = n / c("n_rows")
    override = c("null_threshold") if options.get("overrides") else F.lit(None).cast("double")
    forced = c("severity_override") if options.get("overrides") else F.lit(None).cast("string")
    level = F.coalesce(
        forced,
        F.when(override.isNotNull(), F.when(share >= override, "high")),
        F.when(override.isNull(), F.when(share >= K.NULL_SHARES["high"], "high").when(share >= K.NULL_SHARES["medium"], "medium").when(share >= K.NULL_SHARES["low"], "low")),
    )
    text = F.concat(F.lit("Column '"), c("column"), F.lit("' has "), n.cast("string"), F.lit(" missing values"))
    return F.when((n > 0) & level.isNotNull(), issue(
        "missing_values", "missing_values", level, n, percent(n, c("n_rows")), 0.95, text,
        details(null_count=n, null_percentage=percent(n, c("n_rows")), total_rows=c("n_rows")),
    ))


def pseudo_nulls(options: dict) -> Column:
    n, share = c("n_pseudo"), percent(c("n_pseudo"), c("n_rows"))
    text = F.concat(F.lit("Column '"), c("column"), F.lit("' has "), n.cast("string"), F.lit(" disguised nulls"))
    level = bands(share, [(30, "high"), (10, "medium")], "low", strict=True)
    return F.when(n > 0, issue("pseudo_nulls", "missing_values", level, n, share, 0.92, text, details(pseudo_null_count=n)))


def mixed_types(options: dict) -> Column:
    numbers, n = c("n_number"), c("n_values") - c("n_number")
    text = F.concat(F.lit("Column '"), c("column"), F.lit("' mixes numbers with "), n.cast("string"), F.lit(" other values"))
    return F.when((numbers > 0) & (numbers < 0.9 * c("n_values")), issue(
        "mixed_types", "type_mismatch", "medium", n, percent(n, c("n_values")), 0.85, text,
        details(numeric_count=numbers, non_numeric_count=n),
    ))


def wrong_format(options: dict) -> Column:
    """Values that break the format promised by the column name; disguised nulls do not count."""
    valid = lookup_metric(c("name_format"))
    total = c("n_values") - c("n_pseudo")
    n = total - valid
    share = percent(n, total)
    level = bands(share, [(50, "high"), (20, "medium")], "low", strict=True)
    tolerance = F.when(c("strict_format"), F.lit(0.0)).otherwise(F.lit(5.0)) if options.get("overrides") else F.lit(5.0)
    text = F.concat(F.lit("Column '"), c("column"), F.lit("' has "), n.cast("string"), F.lit(" values that are no "), c("name_format"))
    return F.when((n > 0) & (share >= tolerance), issue(
        "format", "format_error", level, n, share, 0.87, text, details(format_expected=c("name_format"), invalid_count=n)
    ))


def lookup_metric(fmt: Column) -> Column:
    out = F.lit(None).cast("bigint")
    for name in ("email", "phone", "url", "postal", "siret", "siren", "ip"):
        out = F.when(fmt == name, c(f"n_{name}")).otherwise(out)
    return out


def repeats() -> Column:
    """Rows beyond the first of each value; nulls together are one value."""
    return c("n_rows") - c("n_distinct") - F.when(c("n_rows") > c("n_values"), 1).otherwise(0)


def identifier_repeats(options: dict) -> Column:
    n = repeats()
    text = F.concat(F.lit("Identifier '"), c("column"), F.lit("' has "), n.cast("string"), F.lit(" repeated values"))
    return F.when(c("name_is_id") & (n > 0), issue(
        "unique_identifier", "constraint_violation", "high", n, percent(n, c("n_rows")), 0.9, text, details(duplicate_count=n, kind="duplicate")
    ))


def _semantic(kind: str, rule_id: str, n: Column, words: str, options: dict) -> Column:
    text = F.concat(F.lit("Column '"), c("column"), F.lit("' has "), n.cast("string"), F.lit(f" {words}"))
    trusted = (c("semantic_type") == kind) & (c("semantic_confidence") >= options.get("min_confidence", 0.6))
    return F.when(trusted & (n > 0), issue(
        rule_id, "anomaly", "medium", n, percent(n, c("n_rows")), c("semantic_confidence"), text,
        details(semantic_type=c("semantic_type"), detection_method="semantic"),
    ))


def negative_amounts(options: dict) -> Column:
    return _semantic("monetary_amount", "negative_amount", c("n_negative"), "negative amounts", options)


def percentages_off_range(options: dict) -> Column:
    return _semantic("percentage", "percentage_range", c("n_off_percent"), "values outside 0 to 100", options)


def ages_off_range(options: dict) -> Column:
    return _semantic("age", "age_range", c("n_off_age"), "values outside 0 to 150", options)


def semantic_format(options: dict) -> Column:
    """Values that break the format of the business type, among all rows; padding breaks it too."""
    valid = F.lit(None).cast("bigint")
    for kind, fmt in K.SEMANTIC_FORMATS.items():
        valid = F.when(c("semantic_type") == kind, c(f"n_exact_{fmt}")).otherwise(valid)
    n = c("n_values") - valid
    share = 100.0 * n / c("n_rows")
    trusted = c("semantic_confidence") >= options.get("min_confidence", 0.6)
    text = F.concat(F.lit("Column '"), c("column"), F.lit("' has "), n.cast("string"), F.lit(" values that are no "), c("semantic_type"))
    return F.when(trusted & (n > 0) & (share >= 5.0), issue(
        "semantic_format", "format_error", "medium", n, F.round(share, 2), F.round(c("semantic_confidence") * 0.9, 3), text,
        details(semantic_type=c("semantic_type"), invalid_count=n),
    ))


CHECKS: dict[str, tuple[Callable[[dict], Column], list[str]]] = {
    "missing_values": (missing_values, []),
    "pseudo_nulls": (pseudo_nulls, ["n_pseudo"]),
    "mixed_types": (mixed_types, ["n_number"]),
    "format": (wrong_format, ["n_pseudo", "n_email", "n_phone", "n_url", "n_postal", "n_siret", "n_siren"]),
    "unique_identifier": (identifier_repeats, ["n_distinct"]),
    "negative_amount": (negative_amounts, SEMANTIC_METRICS),
    "percentage_range": (percentages_off_range, SEMANTIC_METRICS),
    "age_range": (ages_off_range, SEMANTIC_METRICS),
    "semantic_format": (semantic_format, SEMANTIC_METRICS),
}
SEMANTIC_CHECKS = {"negative_amount", "percentage_range", "age_range", "semantic_format"}
STANDARD = list(CHECKS)


def check_metrics(df: DataFrame, checks: Sequence[str], columns: Sequence[str] | None = None, semantic: DataFrame | None = None,
                  extra: Sequence[str] = ()) -> DataFrame:
    """The metrics the listed checks need and ``extra`` ones, with distinct counts and types where asked for."""
    wanted = {m for name in checks for m in CHECKS[name][1]} | set(extra)
    with_types = bool(SEMANTIC_CHECKS & set(checks))
    rows = M.column_metrics(df, columns, wanted - {"n_distinct"})
    if "n_distinct" in wanted or (with_types and semantic is None):
        rows = M.with_distinct(rows, df, columns)
    if with_types:
        if semantic is None:
            rows = rows.withColumn("_c", classification()).withColumns(
                {"semantic_type": c("_c.semantic_type"), "semantic_confidence": c("_c.confidence")}
            ).drop("_c")
        else:
            given = semantic.select("column", "semantic_type", c("confidence").alias("semantic_confidence"))
            rows = rows.join(small(given), "column", "left")
    return rows


def issues_from_metrics(rows: DataFrame, checks: Sequence[str] = STANDARD, overrides: DataFrame | None = None,
                        dataset_id: str = "table", **options) -> DataFrame:
    """Issues of all columns; the metrics are read once however many checks there are."""
    if overrides is not None:
        fields = overrides.select("column", "null_threshold", "severity_override", "strict_format")
        rows = rows.join(small(fields), "column", "left")
    options = options | {"overrides": overrides is not None}
    found = F.array_compact(F.array(*[CHECKS[name][0](options) for name in checks]))
    return finish(rows.select("column", F.explode(found).alias("i")).select("column", "i.*"), dataset_id)


def column_issues(df: DataFrame, checks: Sequence[str] = STANDARD, columns: Sequence[str] | None = None,
                  semantic: DataFrame | None = None, overrides: DataFrame | None = None, dataset_id: str = "table", **options) -> DataFrame:
    rows = check_metrics(df, checks, columns, semantic)
    return issues_from_metrics(rows, checks, overrides, dataset_id, **options)


# Table checks

LONG_TEXT = 64

def repeated_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(columns..., n) of the rows that occur more than once.

    One count by all columns, combined before the shuffle, so a row with very many copies crosses it
    once per task. Texts over LONG_TEXT bytes are grouped by their SHA-256 and read back only by
    callers who ask for them. Nulls equal each other.
    """
    columns = list(columns or plain_columns(df))
    types = dict(df.dtypes)
    cells, values = [], []
    for i, x in enumerate(columns):
        cell = F.col(f"`{x}`")
        if types[x] == "string":
            # one character longer than LONG_TEXT, so never equal to a text that stays as it is
            cells.append(F.when(F.octet_length(cell) > LONG_TEXT, F.concat(F.sha2(cell, 256), F.lit("#"))).otherwise(cell).alias(f"_c{i}"))
            values.append(F.first(cell).alias(x))
        else:
            cells.append(cell.alias(f"_c{i}"))
            values.append(F.col(f"_c{i}").alias(x))
    texts = [v for x, v in zip(columns, values, strict=True) if types[x] == "string"]
    counted = df.groupBy(*cells).agg(F.count(F.lit(1)).alias("n"), *texts).where("n > 1")
    return counted.select(*[F.col(f"`{x}`") if types[x] == "string" else v for x, v in zip(columns, values, strict=True)], "n")


def duplicate_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(duplicate_count, groups, row_count): all copies counted, the first of each included."""
    copies = repeated_rows(df, columns).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_count"), F.count(F.lit(1)).alias("groups")
    )
    rows = df.agg(F.count(F.lit(1)).alias("n"))
    return copies.select("*", rows.scalar().alias("row_count"))


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None, dataset_id: str = "table") -> DataFrame:
    n, share = c("duplicate_count"), percent(c("duplicate_count"), c("row_count"))
    unique = c("row_count") - n + c("groups")
    text = F.concat(n.cast("string"), F.lit(" rows are copies of one another"))
    level = bands(share, [(10, "high"), (1, "medium")], "low", strict=True)
    rows = duplicate_counts(df, columns).where(n > 0).select(
        F.lit(None).cast("string").alias("column"),
        issue("duplicate_rows", "duplicate", level, n, share, 1.0, text, details(duplicate_count=n, unique_rows=unique)).alias("i"),
    ).select("column", "i.*")
    return finish(rows, dataset_id)


# Evidence for an issue

def pseudo_null_tokens(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """The ``k`` most frequent raw disguised nulls per text column."""
    columns = [x for x in (columns or plain_columns(df)) if P.is_text(df.schema[x].dataType)]
    kept = df.select(*[F.when(P.col(P.is_pseudo_null(P.quoted(x))), P.col(P.quoted(x))).alias(x) for x in columns])
    return top_values(value_frequencies(kept, columns), k).select("column", F.col("text").alias("token"), "n", c("place").cast("int").alias("place"))


def affected_rows(df: DataFrame, key: Sequence[str], predicates: dict[str, Column], k: int = 100) -> DataFrame:
    """The first ``k`` rows in ``key`` order that meet each named predicate, from one scan."""
    rows = first_rows_of_each(df, key, {name: (p, F.lit(None)) for name, p in predicates.items()}, k)
    return rows.select(F.col("condition").alias("predicate"), *[f"`{x}`" for x in key])


def examples(df: DataFrame, key: Sequence[str], column: str, predicate: Column, k: int = 10) -> DataFrame:
    """The first ``k`` values of ``column`` in ``key`` order that meet ``predicate``."""
    return df.where(predicate).select(*key, F.col(f"`{column}`").cast("string").alias("value")).orderBy(*key).limit(k)


def not_a_number(column: str) -> Column:
    v = P.quoted(column)
    return P.col(f"{v} is not null and {P.to_number(v)} is null")


