"""Business rules as data: matching rules to columns, and checks that a rule spells out.

A rule row is (rule_id, text, rule_type, severity, category, active) plus, for executable rules,
``kind`` and ``params``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import constants as K
from plumbline.functions import predicates as P
from plumbline.functions.expressions import contains_any, percent, small
from plumbline.operators.checks import c, details, finish, issue, repeats
from plumbline.operators.nearrows import wide_near_duplicates
from plumbline.operators.nearsubsets import near_duplicates_by_subsets
from plumbline.operators.similarity import text_top_k


def active_rules(rules: DataFrame, rule_type: str | None = None) -> DataFrame:
    rows = rules.where(F.coalesce("active", F.lit(True)))
    return rows.where(c("rule_type") == rule_type) if rule_type else rows


def rules_by_category(rules: DataFrame) -> DataFrame:
    """Active rules counted by category and severity."""
    counts = active_rules(rules).groupBy("category").pivot("severity", K.SEVERITIES).count()
    return counts.select("category", *[F.coalesce(s, F.lit(0)).alias(s) for s in K.SEVERITIES])


def match_rules(columns: DataFrame, rules: DataFrame, k: int = 3, threshold: float = 0.55,
                query: Column | None = None) -> DataFrame:
    """Up to ``k`` relevant rules per column: (column, rule_id, similarity, place, rule fields).

    ``columns`` holds a ``column`` name and whatever ``query`` is built from; the default question is
    made of the column name.
    """
    if query is None:
        query = F.concat(F.lit("column "), F.translate("column", "_", " "), F.lit(" constraint validation rule"))
    asked = columns.select("column", query.alias("_query")).distinct()
    live = active_rules(rules)
    hits = text_top_k(asked, live, "column", "_query", "rule_id", "text", k, threshold)
    return hits.join(live.select("rule_id", "text", "rule_type", "severity", "category"), "rule_id")


def overrides_from_rules(matches: DataFrame) -> DataFrame:
    """Per column: the null threshold, severity and format tolerance its matched rules call for."""
    text = F.lower("text")

    def any_of(words: Sequence[str]) -> Column:
        return F.bool_or(contains_any(text, words))

    required, nullable = any_of(K.RULE_REQUIRED_WORDS), any_of(K.RULE_NULLABLE_WORDS)
    return matches.groupBy("column").agg(
        F.when(required, 0.01).when(nullable, 0.8).alias("null_threshold"),
        F.when(any_of(K.RULE_KEY_WORDS), "critical").alias("severity_override"),
        any_of(K.RULE_STRICT_WORDS).alias("strict_format"),
    )


def rule_issues(metrics: DataFrame, matches: DataFrame, dataset_id: str = "table") -> DataFrame:
    """Uniqueness and not-null rules run on the columns they were matched to.

    ``metrics`` must hold distinct counts; a rule that asks for both is read as a uniqueness rule.
    """
    joined = metrics.join(small(matches.select("column", "rule_id", "text", "severity", "similarity")), "column")
    text = F.lower("text")
    unique, required = contains_any(text, K.RULE_UNIQUE_WORDS), contains_any(text, K.RULE_NOT_NULL_WORDS)
    n = F.when(unique, repeats()).when(required, c("n_rows") - c("n_values"))
    kind = F.when(unique, "duplicate").otherwise("null")
    words = F.concat(F.lit("Rule '"), c("rule_id"), F.lit("' is broken by "), n.cast("string"), F.lit(" rows of '"), c("column"), F.lit("'"))
    found = issue(c("rule_id"), "constraint_violation", F.coalesce("severity", F.lit("medium")), n, percent(n, c("n_rows")),
                  F.round("similarity", 4), words, details(rule_text=c("text"), kind=kind))
    return finish(joined.where(n > 0).select("column", found.alias("i")).select("column", "i.*"), dataset_id)


# Rules that name their columns. Each predicate is true on a row that breaks the rule.

def ends_before_start(start: str, end: str) -> Column:
    return F.col(end) < F.col(start)


def negative(column: str) -> Column:
    return F.col(column) < 0


def bad_phone_characters(column: str) -> Column:
    """Anything but digits, blanks, dashes and plus signs."""
    return ~F.col(column).rlike(r"^[0-9 +\-]+\z")


def in_the_future(column: str, as_of: str) -> Column:
    return F.col(column) > F.lit(as_of).cast("timestamp_ntz")


def corrupt_text(column: str) -> Column:
    return P.col(P.is_corrupt_text(P.quoted(column)))


def corrupt_bytes(column: str) -> Column:
    return ~F.is_valid_utf8(F.col(column).cast("string"))


def required_but_blank(column: str) -> Column:
    return P.col(P.is_blank(P.quoted(column)))


def count_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule_id, violations, row_count) of any number of row predicates, in one scan."""
    row = df.agg(F.count(F.lit(1)).alias("row_count"), *[
        F.count(F.when(p, F.lit(1))).alias(f"r{i}") for i, p in enumerate(rules.values())
    ])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule_id"), F.col(f"r{i}").alias("violations"), c("row_count").alias("row_count"))
        for i, name in enumerate(rules)
    ])).alias("r")).select("r.*")


def predicate_issues(df: DataFrame, rules: dict[str, tuple[Column, str, str | None]], dataset_id: str = "table") -> DataFrame:
    """Issues of row rules given as {rule_id: (predicate, severity, column)}."""
    counts = count_violations(df, {k: v[0] for k, v in rules.items()})
    table = F.create_map(*[x for k, v in rules.items() for x in (F.lit(k), F.struct(F.lit(v[1]).alias("severity"), F.lit(v[2]).cast("string").alias("column")))])
    n = c("violations")
    words = F.concat(F.lit("Rule '"), c("rule_id"), F.lit("' is broken by "), n.cast("string"), F.lit(" rows"))
    rows = counts.where(n > 0).withColumn("_s", F.element_at(table, c("rule_id")))
    found = issue(c("rule_id"), "constraint_violation", c("_s.severity"), n, percent(n, c("row_count")), 0.95, words, details(kind="rule"))
    return finish(rows.select(c("_s.column").alias("column"), found.alias("i")).select("column", "i.*"), dataset_id)


def high_cardinality(counts: DataFrame, limit: int = 1000) -> DataFrame:
    """Columns with more than ``limit`` distinct values, from ``profile.column_counts``."""
    return counts.where(c("unique_count") > limit).select("column", "unique_count")


def beyond_deviations(df: DataFrame, column: str, key: Sequence[str], limit: float = 3.0) -> DataFrame:
    """Rows more than ``limit`` standard deviations from the mean, with their z-score."""
    x = P.col(P.as_double(column, df.schema[column].dataType))
    stats = df.agg(F.struct(F.avg(x).alias("mean"), F.when(F.min(x) < F.max(x), F.stddev_samp(x)).alias("std")).alias("s")).scalar()
    rows = df.select(*key, x.alias("value")).where(c("value").isNotNull()).withColumn("_s", stats)
    z = F.try_divide(c("value") - c("_s.mean"), c("_s.std"))  # null in a constant column
    return rows.where(F.abs(z) > limit).select(*key, "value", z.alias("z_score"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """(key, n): foreign keys without a parent row, null keys left out.

    The child keys are counted before the join, so a hot key crosses the shuffle once per task.
    """
    keys = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return keys.join(parent.select(F.col(parent_key).alias("key")), "key", "left_anti")


MOST_SUBSETS = 1000  # subsets of columns; where there would be more, rows meet on blocks of columns


def near_duplicates(df: DataFrame, block: Sequence[str], compare: Sequence[str], ratio: float = 0.9, most_subsets: int = MOST_SUBSETS) -> DataFrame:
    """Distinct rows (block and compared columns) with ``copies`` and the number of ``partners``, if they have any.

    A partner is another row of the same block that agrees on at least ``ratio`` of the compared columns, null
    agreeing with null; copies of the row count too. Exact copies are folded first.

    Few columns: the groups of equal values of each subset of at least that many columns are counted and rows never paired
    (``nearsubsets``). Many columns (more than ``most_subsets`` subsets): ``nearrows.wide_near_duplicates``, with the same result.
    """
    m = len(compare)
    least = math.ceil(ratio * m - 1e-9)
    if not 1 <= least <= m:
        raise ValueError("the ratio must ask for at least one of the compared columns and at most all")
    columns = [*block, *compare]
    if sum(math.comb(m, k) for k in range(least, m + 1)) <= most_subsets:
        return near_duplicates_by_subsets(df, block, compare, least)
    rows = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    return wide_near_duplicates(rows, block, compare, least)


# Executable rules: a rule row with ``kind`` and ``params``, bound to columns by the caller.

def _number(column: str) -> Column:
    """A column of numbers or of text as double; text that is no number is null and breaks no limit."""
    return P.col(P.to_number(f"cast({P.quoted(column)} as string)"))


ROW_KINDS = {
    "min": lambda col, p: _number(col) < float(p["limit"]),
    "range": lambda col, p: ~_number(col).between(float(p["low"]), float(p["high"])),
    "format": lambda col, p: ~P.col(P.has_format(P.quoted(col), p["format"])),
    "phone_characters": lambda col, p: bad_phone_characters(col),
    "date_order": lambda col, p: ends_before_start(p["start"], col),
    "not_future": lambda col, p: in_the_future(col, p["as_of"]),
    "encoding": lambda col, p: corrupt_text(col),
    "required": lambda col, p: required_but_blank(col),
    "expression": lambda col, p: ~F.expr(p["expression"]),
}


def bind_rules(rules: DataFrame, bindings: dict[str, list[str]], **params: str) -> dict[str, tuple[Column, str, str]]:
    """Row predicates of the active rules with a row kind, for ``predicate_issues``; another kind that is bound is an error.

    ``bindings`` names the columns of each rule id; ``params`` are added to the rule's own. A rule of
    kind 'expression' holds SQL that is true on good rows. The rules are a table of parameters.
    """
    out = {}
    for r in active_rules(rules).collect():
        if r["rule_id"] in bindings and r["kind"] not in ROW_KINDS:
            raise ValueError(f"rule '{r['rule_id']}' of kind '{r['kind']}' judges no single rows; row kinds are {', '.join(ROW_KINDS)}")
        for column in bindings.get(r["rule_id"], []):
            predicate = ROW_KINDS[r["kind"]](column, {**(r["params"] or {}), **params})
            out[f"{r['rule_id']}:{column}"] = (predicate, r["severity"], column)
    return out
