"""Proposed corrections, their validation, applying them, and the comparison afterwards."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import constants as K
from plumbline.functions import predicates as P
from plumbline.functions.expressions import contains_any, lookup, small
from plumbline.operators.checks import details
from plumbline.operators.frequencies import plain_columns, top_values, value_frequencies
from plumbline.operators.metrics import column_metrics
from plumbline.operators.ordering import quantiles

c = F.col
IMPUTATIONS = ["impute_mean", "impute_median", "impute_mode"]


# Statistics that corrections need

def fill_statistics(df: DataFrame, columns: Sequence[str] | None = None, dataset_id: str = "table") -> DataFrame:
    """(dataset_id, column, is_numeric, mean, std, median, p1, p99, mode) with disguised nulls left out."""
    columns = list(columns or plain_columns(df))
    clean = df.selectExpr(*[f"{_unmasked(df, x)} as {P.quoted(x)}" for x in columns])
    freq = value_frequencies(clean, columns)
    spread = quantiles(freq.where(c("number").isNotNull()).select("column", "number", "n"), ["column"], [0.01, 0.5, 0.99])
    mode = top_values(freq, 1).select("column", F.coalesce("text", c("number").cast("string")).alias("mode"))
    rows = column_metrics(clean, columns, ["mean", "std"]).join(small(spread), "column", "left").join(small(mode), "column", "left")
    return rows.select(
        F.lit(dataset_id).alias("dataset_id"), "column", c("kind").isin("integer", "float").alias("is_numeric"), "mean", "std",
        F.get("quantiles", F.lit(1)).alias("median"), F.get("quantiles", F.lit(0)).alias("p1"), F.get("quantiles", F.lit(2)).alias("p99"), "mode",
    )


def _unmasked(df: DataFrame, name: str) -> str:
    """The cell with NaN and disguised nulls turned into null, as SQL text."""
    dtype = df.schema[name].dataType
    v = P.present(P.quoted(name), dtype)
    return f"if({P.is_pseudo_null(v)}, null, {v})" if P.is_text(dtype) else v


# Proposals

def _proposal(kind: str, confidence: float, parameters: Column, alternatives: Iterable[str] = ()) -> Column:
    return F.struct(
        F.lit(kind).alias("correction_type"), F.lit(confidence).alias("confidence"), parameters.alias("parameters"),
        F.array(*[F.lit(a) for a in alternatives]).cast("array<string>").alias("alternatives"),
    )


def propose(issues: DataFrame, statistics: DataFrame) -> DataFrame:
    """Proposals for every issue: strategies by issue type, filled with the column's statistics."""
    known = statistics.withColumn("_known", F.lit(True)).withColumnRenamed("column", "_column")
    # issues without a column get a key of their own: nulls would all meet in one task
    rows = issues.withColumn("_column", F.coalesce("column", F.concat(F.lit("\0"), "issue_id"))).join(known, ["dataset_id", "_column"], "left")
    kind, known = c("issue_type"), F.coalesce(c("_known"), F.lit(False))
    at = lambda **extra: details(column=c("column"), **extra)
    missing = (kind == "missing_values") & known
    options = F.array(
        F.when(missing & c("is_numeric"), _proposal("impute_median", 0.8, at(value=c("median")), ["impute_mean", "delete_row", "model"])),
        F.when(missing & c("is_numeric"), _proposal("impute_mean", 0.7, at(value=c("mean")), ["impute_median", "delete_row"])),
        F.when(missing & ~c("is_numeric") & c("mode").isNotNull(), _proposal("impute_mode", 0.7, at(value=c("mode")), ["unknown_category", "delete_row"])),
        F.when(missing & (c("affected_percentage") < 5), _proposal("delete_row", 0.85, at(), ["impute"])),
        F.when((kind == "anomaly") & known, _proposal("clip_values", 0.75, at(lower=c("p1"), upper=c("p99")), ["delete_row", "flag_only"])),
        F.when((kind == "anomaly") & known, _proposal("flag_only", 0.9, at(flag_column=F.concat("column", F.lit("_is_anomaly"))), ["clip_values", "delete_row"])),
        F.when(kind == "type_mismatch", _proposal("cast_type", 0.8, at(target_type="numeric", errors="coerce"), ["keep_text", "manual_review"])),
        F.when((kind == "constraint_violation") & (F.element_at("details", "kind") == "duplicate"), _proposal("delete_row", 0.85, at(keep="first"), ["keep_last", "manual_review"])),
        F.when(kind == "constraint_violation", _proposal("manual_review", 0.95, details(reason="constraint_violation"), ["delete_row"])),
        F.when(kind == "drift", _proposal("manual_review", 0.6, at(), ["retrain", "standardize", "update_reference"])),
        F.when(~kind.isin("missing_values", "anomaly", "type_mismatch", "constraint_violation", "drift"), _proposal("manual_review", 0.5, details(reason=kind))),
    )
    out = rows.select("dataset_id", "issue_id", "issue_type", "column", "affected_count", "affected_percentage", F.explode(F.array_compact(options)).alias("p"))
    return out.select(
        "dataset_id", F.sha2(F.concat_ws("|", "issue_id", c("p.correction_type")), 256).substr(1, 16).alias("proposal_id"),
        "issue_id", "issue_type", "column", "p.correction_type", "p.parameters", c("affected_count").alias("rows_affected"), "p.confidence", "p.alternatives",
    )


def adjust_from_feedback(proposals: DataFrame, learned: DataFrame) -> DataFrame:
    """Confidence shifted by the success rate of the correction type: (rate - 0.5) * 0.3, kept in [0.1, 1].

    ``learned`` holds (correction_type, confidence_adjustment), see ``feedback.learn``.
    """
    rows = proposals.join(small(learned.select("correction_type", "confidence_adjustment")), "correction_type", "left")
    shifted = F.greatest(F.lit(0.1), F.least(F.lit(1.0), c("confidence") + c("confidence_adjustment")))
    noted = F.when(c("confidence_adjustment") < -0.1, F.concat(F.array(F.lit("rejected_before")), c("alternatives"))).otherwise(c("alternatives"))
    # greatest() and least() skip nulls: without feedback the confidence stays
    shifted = F.when(c("confidence_adjustment").isNull(), c("confidence")).otherwise(shifted)
    return rows.withColumn("confidence", shifted).withColumn("alternatives", noted).select(*proposals.columns)


def confidence_adjustment(rate: Column) -> Column:
    return (rate - 0.5) * 0.3


# Validation

def clip_counts(df: DataFrame, proposals: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, changed): values outside the proposed clip bounds, one scan for all proposals.

    The bounds are one struct per column, at most as many as the table has columns.
    """
    names = [x for x in (columns or plain_columns(df)) if P.is_numeric(df.schema[x].dataType)]
    bounds = proposals.where(c("correction_type") == "clip_values").groupBy("column").agg(
        F.max(F.element_at("parameters", "lower").cast("double")).alias("lower"), F.max(F.element_at("parameters", "upper").cast("double")).alias("upper")
    )
    table = bounds.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("lower", "upper")))).alias("b"))
    rows = df.select(*[P.col(P.as_double(x, df.schema[x].dataType)).alias(x) for x in names]).withColumn("_b", table.scalar())
    row = rows.agg(*[
        F.count(F.when((F.col(f"`{x}`") < F.element_at("_b", F.lit(x)).lower) | (F.col(f"`{x}`") > F.element_at("_b", F.lit(x)).upper), 1)).alias(str(i))
        for i, x in enumerate(names)
    ])
    return row.select(F.explode(F.array(*[F.struct(F.lit(x).alias("column"), F.col(str(i)).alias("changed")) for i, x in enumerate(names)])).alias("r")).select("r.*")


def validate(proposals: DataFrame, columns: DataFrame, totals: DataFrame, rule_matches: DataFrame | None = None, changed: DataFrame | None = None) -> DataFrame:
    """A verdict per proposal, from its parameters, the table's size and the rules of its column.

    ``columns``: (dataset_id, column, is_numeric); ``totals``: (dataset_id, row_count);
    ``rule_matches``: (column, rule_id, text); ``changed``: (column, changed) of ``clip_counts``.
    """
    target = F.element_at("parameters", "column")
    rows = proposals.withColumn("target", target).withColumn("_target", F.coalesce(target, F.concat(F.lit("\0"), "proposal_id"))).join(
        columns.select("dataset_id", c("column").alias("_target"), c("is_numeric").alias("_numeric"), F.lit(True).alias("_exists")), ["dataset_id", "_target"], "left"
    ).join(totals.select("dataset_id", "row_count"), "dataset_id")
    if changed is not None:
        rows = rows.join(small(changed.select(c("column").alias("target"), "changed")), "target", "left")
    else:
        rows = rows.withColumn("changed", F.lit(None).cast("bigint"))
    kind, n, total = c("correction_type"), c("rows_affected"), c("row_count")
    exists, numeric = F.coalesce("_exists", F.lit(False)), F.coalesce("_numeric", F.lit(False))
    lower, upper = (F.element_at("parameters", k).cast("double") for k in ("lower", "upper"))
    left = total - n
    drops = (kind == "delete_row") & exists
    reasons = F.array_compact(F.array(
        F.when(c("target").isNotNull() & ~exists, "unknown column"),
        F.when((kind == "clip_values") & exists & (lower >= upper), "clip bounds out of order"),
        F.when((kind == "impute_custom") & (exists | c("target").isNull()) & F.element_at("parameters", "value").isNull(), "no value to impute"),
        F.when(drops & (left < 10), "fewer than 10 rows would remain"),
    ))
    warnings = F.array_compact(F.array(
        F.when((exists | c("target").isNull()) & (n > 0.5 * total), "touches more than half of the rows"),
        F.when(drops & (left >= 10) & (left < 0.1 * total), "less than a tenth of the rows would remain"),
        F.when(kind.isin("impute_mean", "impute_median") & exists & numeric & (n > 0.3 * total), "imputes so much that the variance shrinks"),
        F.when((kind == "clip_values") & exists & numeric & (c("changed") > 1.5 * n), "clips more values than planned"),
        F.when(c("confidence") < 0.5, "low confidence"),
    ))
    rows = rows.withColumn("_reasons", reasons).withColumn("_warnings", warnings)
    if rule_matches is not None:
        checked = check_rules(rows, rule_matches)
        rows = rows.join(checked, "proposal_id", "left")
    else:
        rows = rows.withColumns({k: F.lit(None).cast("array<string>") for k in ("rules_checked", "rules_failed")})
    none = F.array().cast("array<string>")
    rows = rows.withColumns({k: F.coalesce(k, none) for k in ("rules_checked", "rules_failed")})
    valid = (F.size("_reasons") == 0) & (F.size("rules_failed") == 0)
    status = F.when(~valid, "rejected").when(F.size("_warnings") > 0, "approved_with_warnings").otherwise("approved")
    return rows.select(
        "dataset_id", "proposal_id", valid.alias("is_valid"), status.alias("status"), c("_reasons").alias("reasons"), c("_warnings").alias("warnings"),
        "rules_checked", F.array_except("rules_checked", "rules_failed").alias("rules_passed"), "rules_failed",
    )


def check_rules(rows: DataFrame, rule_matches: DataFrame) -> DataFrame:
    """(proposal_id, rules_checked, rules_failed): proposals against the rules matched to their column.

    A handful of rules per column match (``match_rules`` keeps k), so the lists stay short.
    """
    text, target = F.lower("rule_text"), F.lower("target")
    pairs = rows.join(small(rule_matches.select(c("column").alias("target"), "rule_id", c("text").alias("rule_text"))), "target")
    names_id = named_identifier(target)
    broken = (
        (text.contains("null") & (c("correction_type") == "delete_row") & (c("rows_affected") > 0.3 * c("row_count")))
        | (contains_any(text, ["unique", "id"]) & names_id & c("correction_type").isin(IMPUTATIONS))
        | (contains_any(text, K.RULE_POSITIVE_WORDS) & (c("correction_type") == "clip_values") & (F.element_at("parameters", "lower").cast("double") < 0))
    )
    return pairs.groupBy("proposal_id").agg(
        F.sort_array(F.collect_set("rule_id")).alias("rules_checked"), F.sort_array(F.collect_set(F.when(broken, c("rule_id")))).alias("rules_failed")
    )


def named_identifier(name: Column) -> Column:
    """An identifier by its name: 'id' as a whole part of it."""
    return name.rlike(r"(^|[_\-\s])id([_\-\s]|$)")


def approve(proposals: DataFrame, validations: DataFrame) -> DataFrame:
    """Proposals with the verdict written back."""
    verdict = validations.select("proposal_id", c("is_valid").alias("is_approved"), F.when(c("is_valid"), "validator").alias("approved_by"))
    return proposals.join(verdict, "proposal_id")


def validation_summary(validations: DataFrame) -> DataFrame:
    return validations.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def proposal_summary(proposals: DataFrame) -> DataFrame:
    return proposals.groupBy("correction_type").agg(F.count(F.lit(1)).alias("n"))


# Plans and estimates

def correction_plan(issues: DataFrame) -> DataFrame:
    """Issues with the recommended action and whether it runs by itself."""
    action = lookup(c("issue_type"), {k: v[0] for k, v in K.CORRECTION_ACTIONS.items()}, "manual_review")
    auto = lookup(c("issue_type"), {k: v[1] for k, v in K.CORRECTION_ACTIONS.items()}, False)
    return issues.select(
        "dataset_id", "issue_id", "issue_type", "severity", "column", "affected_count", "affected_percentage",
        action.alias("recommended_action"), auto.alias("auto_applicable"),
    )


def estimated_score(plan: DataFrame, scores: DataFrame) -> DataFrame:
    """(dataset_id, score, auto, manual, estimated_score): what the automatic corrections are worth."""
    gain = F.sum(F.when(c("auto_applicable"), lookup(c("severity"), K.PLAN_GAIN, 0)).otherwise(0))
    found = plan.groupBy("dataset_id").agg(
        F.count(F.when(c("auto_applicable"), 1)).alias("auto"), F.count(F.when(~c("auto_applicable"), 1)).alias("manual"), gain.alias("gain")
    )
    return scores.join(found, "dataset_id", "left").fillna(0, ["auto", "manual", "gain"]).select(
        "dataset_id", "score", "auto", "manual", F.least(F.lit(100.0), c("score") + c("gain")).alias("estimated_score")
    )


def estimated_improvement(proposals: DataFrame, scores: DataFrame) -> DataFrame:
    """(dataset_id, estimated_improvement): 5 points per proposal not refused, up to the room left."""
    pending = proposals.where(F.coalesce(c("is_approved"), F.lit(True)) if "is_approved" in proposals.columns else F.lit(True))
    counts = pending.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("pending"))
    return scores.join(counts, "dataset_id", "left").select(
        "dataset_id", F.round(F.least(100.0 - c("score"), 5.0 * F.coalesce("pending", F.lit(0))), 1).alias("estimated_improvement")
    )


# Applying corrections

@dataclass
class CorrectionPlan:
    """What to do to a table; any field may be empty."""

    drop_duplicates: bool = False
    unmask: list[str] = field(default_factory=list)  # disguised nulls to null
    trim: list[str] = field(default_factory=list)
    cast: list[str] = field(default_factory=list)
    impute: dict[str, str] = field(default_factory=dict)  # column -> median | mean | mode | a value
    clip: dict[str, tuple[float, float]] = field(default_factory=dict)
    clip_to_percentiles: list[str] = field(default_factory=list)
    standardize: list[str] = field(default_factory=list)
    flag: dict[str, Column] = field(default_factory=dict)  # new column -> condition
    drop_rows: Column | None = None
    drop_columns: list[str] = field(default_factory=list)
    cast_threshold: float = 0.5


def plan_from_issues(issues: DataFrame, df: DataFrame, cast_threshold: float = 0.5) -> CorrectionPlan:
    """The automatic plan of an issue table: the issues of a table are at most a few per column."""
    plan = CorrectionPlan(cast_threshold=cast_threshold)
    found = issues.select("issue_type", "column").distinct().collect()
    for kind, column in sorted((r["issue_type"], r["column"] or "") for r in found):
        if kind == "duplicate":
            plan.drop_duplicates = True
        if column not in df.columns:
            continue
        dtype = df.schema[column].dataType
        if kind == "missing_values":
            if P.is_text(dtype):
                plan.unmask.append(column)
            plan.impute[column] = "median" if P.is_numeric(dtype) else "mode"
        elif kind == "format_error":
            plan.trim.append(column)
        elif kind == "type_mismatch":
            plan.cast.append(column)
    return plan


def drop_duplicate_keys(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the order of ``order``.

    ``min_by`` folds copies map-side: a key held by a third of the rows is one row per task, where a
    window would bring all its rows to one task.
    """
    others = [x for x in df.columns if x not in key]
    first = F.min_by(F.struct(*[F.col(f"`{x}`") for x in others]), F.struct(*[F.col(f"`{x}`") for x in order]))
    rows = df.groupBy(*key).agg(first.alias("_r"))
    return rows.select(*[F.col(x) if x in key else F.col("_r").getField(x).alias(x) for x in df.columns])


def castable_columns(df: DataFrame, columns: Sequence[str], threshold: float = 0.5) -> list[str]:
    """Text columns whose share of numbers among all rows reaches ``threshold`` (one row per column)."""
    text = [x for x in columns if P.is_text(df.schema[x].dataType)]
    if not text:
        return []
    rows = column_metrics(df, text, ["n_number"]).select("column", (c("n_number") / F.greatest(c("n_rows"), F.lit(1)) >= threshold).alias("ok"))
    return [r["column"] for r in rows.collect() if r["ok"]]


def apply(df: DataFrame, plan: CorrectionPlan) -> DataFrame:
    """The corrected table, as one projection over the (deduplicated) input.

    Per column in a fixed order: disguised nulls to null, trim, cast, clip, impute, standardise. The
    statistics come from one row per column, computed once and inlined.
    """
    out = df.dropDuplicates() if plan.drop_duplicates else df
    if plan.drop_rows is not None:
        out = out.where(~F.coalesce(plan.drop_rows, F.lit(False)))
    casts = set(castable_columns(out, plan.cast, plan.cast_threshold))
    clean = {}
    for x in out.columns:
        dtype = out.schema[x].dataType
        v = _unmasked(out, x) if x in plan.unmask else P.present(P.quoted(x), dtype)
        if x in plan.trim and P.is_text(dtype):
            v = P.strip(v)
        if x in casts:
            v = P.to_number(v)
        clean[x] = v
    staged = out.selectExpr(*[f"{v} as {P.quoted(x)}" for x, v in clean.items()])
    keep = [x for x in staged.columns if x not in plan.drop_columns]
    computed = [x for x, how in plan.impute.items() if how in ("median", "mean", "mode")]
    needed = sorted({*computed, *plan.clip_to_percentiles, *plan.standardize} & set(staged.columns))
    if needed:
        stats = fill_statistics(staged, needed).agg(F.map_from_entries(F.collect_list(F.struct(
            "column", F.struct("mean", "std", "median", "p1", "p99", "mode")
        ))).alias("s"))
        staged = staged.withColumn("_s", stats.scalar())

    def cell(x: str) -> Column:
        dtype = staged.schema[x].dataType
        v, of = F.col(f"`{x}`"), lambda f: F.element_at("_s", F.lit(x)).getField(f)
        if x in plan.clip:
            v = _bounded(v, *[F.lit(b) for b in plan.clip[x]], dtype)
        if x in plan.clip_to_percentiles:
            v = _bounded(v, of("p1"), of("p99"), dtype)
        if x in plan.impute:
            how = plan.impute[x]
            fill = of(how) if how in ("median", "mean", "mode") else F.lit(how)
            if how == "mode" and not P.is_text(dtype) or how not in ("median", "mean", "mode"):
                fill = fill.try_cast(dtype)
            v = F.coalesce(v, fill)
        if x in plan.standardize:
            v = F.when(of("std") > 0, F.try_divide(v - of("mean"), of("std"))).otherwise(v.cast("double") * 0.0)  # 0 in a constant column
        return v.alias(x)

    flags = [F.coalesce(cond, F.lit(False)).alias(name) for name, cond in plan.flag.items()]
    return staged.select(*[cell(x) for x in keep], *flags)


def _bounded(v: Column, low: Column, high: Column, dtype) -> Column:
    # greatest() and least() skip nulls, a null must stay one
    return F.when(v.isNotNull(), F.greatest(low, F.least(high, v.cast("double"))))


def apply_report(before: DataFrame, after: DataFrame, corrections: int) -> DataFrame:
    """(rows_before, rows_after, corrections)."""
    n = F.count(F.lit(1)).alias("n")
    return before.agg(n).select(
        c("n").alias("rows_before"), after.agg(n).scalar().alias("rows_after"), F.lit(corrections).alias("corrections")
    )


# Comparison

def improved_columns(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, before, after) of the columns whose score rose; scores as (dataset_id, column, score)."""
    b = before.select("column", c("score").alias("before"))
    a = after.select("column", c("score").alias("after"))
    return b.join(a, "column").where(c("after") > c("before"))


def issue_type_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(issue_type, status): types that disappeared and types that remain."""
    b, a = before.select("issue_type").distinct(), after.select("issue_type").distinct()
    return b.exceptAll(a).withColumn("status", F.lit("removed")).unionByName(b.intersect(a).withColumn("status", F.lit("remaining")))


def comparison(score_before: DataFrame, score_after: DataFrame) -> DataFrame:
    """(score_before, score_after, delta) of two one-row score tables."""
    b = score_before.select("dataset_id", c("score").alias("score_before"))
    a = score_after.select("dataset_id", c("score").alias("score_after"))
    return b.join(a, "dataset_id").select("dataset_id", "score_before", "score_after", F.round(c("score_after") - c("score_before"), 2).alias("delta"))
