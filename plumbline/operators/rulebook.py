"""Rule rows compiled to one plan: every kind of rule becomes a count, and the counts become issues.

Kinds that judge single rows, and the share of missing values, are counts of one aggregate over one scan. Uniqueness, cardinality
and deviations are read off one table of value counts. Only near-duplicates and foreign keys need work of their own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import predicates as P
from plumbline.functions.expressions import percent, small
from plumbline.operators.checks import c, details, finish, issue
from plumbline.operators.frequencies import value_frequencies
from plumbline.operators.rules import ROW_KINDS, active_rules, near_duplicates, orphans
from plumbline.operators.subwords import subword_top_k

COUNTED_KINDS = ["unique", "cardinality", "deviation"]  # from value counts
OWN_KINDS = ["near_duplicate", "foreign_key"]
KINDS = [*ROW_KINDS, "null_share", *COUNTED_KINDS, *OWN_KINDS]
WHOLE_TABLE = ["near_duplicate"]  # judge the table, not a column
COUNTS = "rule_id string, column string, violations long, n_rows long"


def column_question(columns: DataFrame) -> Column:
    """What is asked about a column: the words of its name, and of its business type if ``columns`` says one."""
    spaced = F.regexp_replace(F.regexp_replace("column", "([a-z0-9])([A-Z])", "$1 $2"), r"[^\p{L}\p{N}]+", " ")
    return F.concat_ws(" ", spaced, F.translate("semantic_type", "_", " ")) if "semantic_type" in columns.columns else spaced


def rules_for_columns(columns: DataFrame, rules: DataFrame, k: int = 3, threshold: float = 0.4, question: Column | None = None) -> DataFrame:
    """(column, rule_id, similarity, place, rule fields): up to ``k`` active rules whose texts hold most of what is asked about a column.

    ``columns`` has a row for each ``column``, with its ``semantic_type`` if it is known.
    """
    asked = columns.select("column", (column_question(columns) if question is None else question).alias("_question")).distinct()
    live = active_rules(rules)
    hits = subword_top_k(asked, live, "column", "_question", "rule_id", "text", k, threshold)
    return hits.join(live.select("rule_id", "text", "rule_type", "severity", "category"), "rule_id")


def bindings_of(matches: DataFrame) -> dict[str, list[str]]:
    """{rule_id: columns} of matched rules: a row for each column and rule."""
    out: dict[str, list[str]] = {}
    for r in matches.select("rule_id", "column").orderBy("rule_id", "column").collect():
        out.setdefault(r["rule_id"], []).append(r["column"])
    return out


def rule_counts(df: DataFrame, rules: DataFrame, bindings: Mapping[str, Sequence[str]], *, as_of: str | None = None, starts: Mapping[str, str] | None = None,
                parents: Mapping[str, tuple[DataFrame, str]] | None = None, block: Sequence[str] = ()) -> DataFrame:
    """(rule_id, column, violations, n_rows): how many rows break each active rule of each column it is bound to; 0 rows included.

    ``bindings`` names the columns of each rule; a rule that isn't named doesn't run. ``as_of`` is now for rules on the future, ``starts`` names the start of
    each end date, ``parents`` the parent table and key of each foreign key, and near-duplicates agree on ``block``. A kind that
    nothing runs, or whose argument is missing, is an error before anything runs. The rules are a table of parameters.

    Counted are: rows that break a predicate; missing values where their share is over ``limit``; rows beyond the first of each value (nulls left
    out); distinct values where they are over ``limit``; values beyond ``limit`` deviations; rows with a near-duplicate; rows
    whose key has no parent. Null values break required and null_share only.
    """
    bound = [(r, col) for r in active_rules(rules).orderBy("rule_id").collect() for col in bindings.get(r["rule_id"], [])]
    needs = {"not_future": as_of is not None, "date_order": bool(starts), "foreign_key": bool(parents)}
    for r, col in bound:
        if r["kind"] not in KINDS:
            raise ValueError(f"rule '{r['rule_id']}' has the kind '{r['kind']}'; kinds are {', '.join(KINDS)}")
        if not needs.get(r["kind"], True) or (r["kind"] == "date_order" and col not in starts) or (r["kind"] == "foreign_key" and col not in parents):
            raise ValueError(f"rule '{r['rule_id']}' of kind '{r['kind']}' lacks its argument for column '{col}'")
    missing = lambda x: P.col(P.missing(P.quoted(x), df.schema[x].dataType))
    given = {"as_of": as_of} if as_of else {}

    scanned = [(r, col) for r, col in bound if r["kind"] in ROW_KINDS or r["kind"] == "null_share"]
    aggregates = []
    for r, col in scanned:
        extra = {"start": starts[col]} if r["kind"] == "date_order" else {}
        broken = missing(col) if r["kind"] == "null_share" else ROW_KINDS[r["kind"]](col, {**(r["params"] or {}), **given, **extra})
        n = F.count_if(broken)
        aggregates.append(F.when(n > float(r["params"]["limit"]) * F.count(F.lit(1)), n).otherwise(0) if r["kind"] == "null_share" else n)
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), *[a.alias(f"r{i}") for i, a in enumerate(aggregates)])
    facts = F.array(*[F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(col).alias("column"), F.col(f"r{i}").cast("long").alias("violations")) for i, (r, col) in enumerate(scanned)], F.struct(F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("string").alias("column"), F.lit(0).cast("long").alias("violations")))
    found = [row.select("n_rows", F.explode(facts).alias("f")).select("f.*", "n_rows").where("rule_id is not null")]

    total = df.agg(F.count(F.lit(1)).alias("n_rows")).scalar()
    counted = [(r, col) for r, col in bound if r["kind"] in COUNTED_KINDS]
    if counted:
        found.append(_from_value_counts(df, counted).withColumn("n_rows", total))
    for r, col in bound:
        if r["kind"] == "foreign_key":
            parent, key = parents[col]
            lost = orphans(df, parent, col, key).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
            found.append(lost.select(F.lit(r["rule_id"]).alias("rule_id"), F.lit(col).alias("column"), "violations", total.alias("n_rows")))
    for r in {r["rule_id"]: r for r, _ in bound if r["kind"] == "near_duplicate"}.values():
        near = near_duplicates(df, list(block), list(bindings[r["rule_id"]]), float((r["params"] or {}).get("ratio", 0.9)))
        rows = near.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("violations"))
        found.append(rows.select(F.lit(r["rule_id"]).alias("rule_id"), F.lit(None).cast("string").alias("column"), "violations", total.alias("n_rows")))
    return reduce(DataFrame.unionByName, found)


def _from_value_counts(df: DataFrame, bound: Sequence[tuple]) -> DataFrame:
    """(rule_id, column, violations) of uniqueness, cardinality and deviation rules, from one count of values."""
    freq = value_frequencies(df, sorted({col for _, col in bound}), digest_over=64)
    wanted = df.sparkSession.createDataFrame([(r["rule_id"], r["kind"], col, float((r["params"] or {}).get("limit", 0))) for r, col in bound], "rule_id string, kind string, column string, limit double")
    spread = freq.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("values"), (F.sum(F.col("n") * F.col("number")) / F.sum("n")).alias("mean"), F.min("number").alias("low"), F.max("number").alias("high"),
    )
    moved = freq.join(small(spread.select("column", "mean")), "column").groupBy("column").agg(F.sum(F.col("n") * (F.col("number") - F.col("mean")) ** 2).alias("squares"))
    limits = wanted.where("kind = 'deviation'").select("column", "rule_id", "limit")
    shape = spread.join(small(moved), "column").withColumn("std", F.when((F.col("values") > 1) & (F.col("low") < F.col("high")), F.sqrt(F.col("squares") / (F.col("values") - 1))))
    far = freq.join(small(shape.select("column", "mean", "std")), "column").join(small(limits), "column")
    beyond = far.where(F.abs(F.col("number") - F.col("mean")) > F.col("limit") * F.col("std")).groupBy("rule_id", "column").agg(F.sum("n").alias("beyond"))
    both = wanted.join(small(shape), "column", "left").join(small(beyond), ["rule_id", "column"], "left")
    n = F.when(c("kind") == "unique", c("values") - c("distinct")).when(c("kind") == "cardinality", F.when(c("distinct") > c("limit"), c("distinct")).otherwise(0)).otherwise(c("beyond"))
    return both.select("rule_id", "column", F.coalesce(n, F.lit(0)).cast("long").alias("violations"))


def run_rules(df: DataFrame, rules: DataFrame, bindings: Mapping[str, Sequence[str]], dataset_id: str = "table", **options) -> DataFrame:
    """The issues of all bound rules (``rule_counts``), a row for each rule and column that rows break."""
    counts = rule_counts(df, rules, bindings, **options).where("violations > 0")
    known = small(rules.select("rule_id", "text", "severity", "kind"))
    n = c("violations")
    words = F.concat(F.lit("Rule '"), c("rule_id"), F.lit("' is broken by "), n.cast("string"), F.lit(" rows"), F.coalesce(F.concat(F.lit(" of '"), c("column"), F.lit("'")), F.lit("")))
    found = issue(c("rule_id"), "constraint_violation", F.coalesce("severity", F.lit("medium")), n, percent(n, c("n_rows")), 0.95, words, details(rule_text=c("text"), kind=c("kind")))
    return finish(counts.join(known, "rule_id").select("column", found.alias("i")).select("column", "i.*"), dataset_id)
