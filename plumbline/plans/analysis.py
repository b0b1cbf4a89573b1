"""Whole runs: profile, check, recommend, correct and compare a table.

``find_issues`` is lazy. ``run`` and ``correct_and_compare`` feed several results from the same small
tables (a few rows per column), so they write those to the checkpoint folder once; otherwise each
result would scan the input again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import checks as C
from plumbline.operators import corrections as R
from plumbline.operators import domains, drift, metrics, outliers, rulebook, rules, scoring
from plumbline.operators import profile as prof
from plumbline.operators import semantic as sem
from plumbline.operators.frequencies import plain_columns
from plumbline.operators.history import dataset_id as identity
from plumbline.session import cut_lineage
from plumbline.sources.readers import read_table

PRESETS = {
    "profile": ["profile"],
    "quality": ["issues"],
    "analyze": ["profile", "issues"],
    "recommend": ["profile", "issues", "proposals"],
    "full": ["profile", "issues", "proposals", "validations"],
}


@dataclass
class QualityReport:
    """The result tables of a run; those a preset leaves out are missing."""

    dataset_id: str
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None


def find_issues(df: DataFrame, *, checks: Sequence[str] = C.STANDARD, duplicates: bool = True, columns: Sequence[str] | None = None,
                semantic: DataFrame | None = None, rule_table: DataFrame | None = None, domain_profiles: DataFrame | None = None,
                reference: DataFrame | None = None, key: Sequence[str] | None = None, detect_outliers: bool = False,
                row_rules: Mapping[str, tuple] | None = None, dataset_id: str | None = None, min_confidence: float = 0.6,
                learned: DataFrame | None = None, measured: DataFrame | None = None) -> DataFrame:
    """The issue table of one table; what runs is what the arguments list, nothing is planned behind them.

    ``measured`` may hold the ``checks.check_metrics`` of the same checks, if they are at hand.
    """
    dataset_id = dataset_id or identity(df)
    rows = measured if measured is not None else C.check_metrics(df, checks, columns, semantic)
    matches = overrides = None
    if rule_table is not None:
        names = df.sparkSession.createDataFrame([(x, t) for x, t in df.dtypes], "column string, type string")
        if semantic is not None:
            names = names.join(semantic.select("column", "semantic_type"), "column", "left")
        matches = rulebook.rules_for_columns(names, rule_table)
        overrides = rules.overrides_from_rules(matches)
    parts = [C.issues_from_metrics(rows, checks, overrides, dataset_id, min_confidence=min_confidence)]
    if duplicates:
        parts.append(C.duplicate_rows(df, columns, dataset_id))
    if matches is not None:
        with_distinct = rows if "n_distinct" in rows.columns else metrics.with_distinct(rows, df, columns)
        parts.append(rules.rule_issues(with_distinct, matches, dataset_id))
    if row_rules:
        parts.append(rules.predicate_issues(df, dict(row_rules), dataset_id))
    if detect_outliers:
        if not key:
            raise ValueError("outliers need the key columns of the table")
        forest = outliers.fit_forest(df, key, columns)
        if forest.steps:
            parts.append(outliers.outlier_issues(outliers.outlier_columns(df, forest), dataset_id))
    if reference is not None:
        n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
        parts.append(drift.drift_issues(drift.detect_drift(reference, df), n, dataset_id))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if domain_profiles is not None:
        types = (semantic if semantic is not None else sem.semantic_types(df, columns)).withColumn("dataset_id", F.lit(dataset_id))
        detected = domains.detect_domain(types, domain_profiles)
        totals = df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("dataset_id", F.lit(dataset_id))
        found = found.unionByName(domains.domain_issues(detected, types, domain_profiles, totals))
        found = domains.raise_severity(found, detected, types, domain_profiles)
    if learned is not None:
        from plumbline.operators.feedback import adjusted_issues

        found = adjusted_issues(found, learned)
    return found


def measure_and_check(df: DataFrame, dataset_id: str, checks: Sequence[str] = C.STANDARD, columns: Sequence[str] | None = None,
                      semantic: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(totals, issues), both written once; one scan gives the totals and the metrics of the checks."""
    rows = C.check_metrics(df, checks, columns, semantic, ["size_bytes"])
    rows = cut_lineage(rows.withColumn("dataset_id", F.lit(dataset_id)))
    found = find_issues(df, checks=checks, columns=columns, semantic=semantic, dataset_id=dataset_id, measured=rows, **options)
    return prof.table_totals(rows, ["dataset_id"]), cut_lineage(found)


def columns_of(df: DataFrame, dataset_id: str) -> DataFrame:
    rows = [(dataset_id, x, i) for i, x in enumerate(plain_columns(df))]
    return df.sparkSession.createDataFrame(rows, "dataset_id string, column string, ordinal int")


def run(df: DataFrame, preset: str = "analyze", *, learned_corrections: DataFrame | None = None, rule_table: DataFrame | None = None, **options) -> QualityReport:
    """A preset over one table: profile, quality, analyze, recommend or full."""
    stages = PRESETS[preset]
    report = QualityReport(options.pop("dataset_id", None) or identity(df))
    out, ident = report.tables, report.dataset_id
    if "profile" in stages:
        out["profile"] = cut_lineage(prof.profile(df))
    if "issues" in stages:
        out["totals"], out["issues"] = measure_and_check(df, ident, rule_table=rule_table, **options)
        out["column_scores"] = scoring.column_scores(columns_of(df, ident), out["issues"])
        out["score"] = scoring.dataset_score(out["totals"], out["issues"])
        out["counts"] = scoring.issue_counts(out["issues"])
    if "proposals" in stages:
        stats = cut_lineage(R.fill_statistics(df, dataset_id=ident))
        proposals = R.propose(out["issues"], stats)
        if learned_corrections is not None:
            proposals = R.adjust_from_feedback(proposals, learned_corrections)
        out["proposals"] = cut_lineage(proposals)
        out["improvement"] = R.estimated_improvement(out["proposals"], out["score"])
        out["plan"] = R.correction_plan(out["issues"])
    if "validations" in stages:
        matches = None
        if rule_table is not None:
            names = df.sparkSession.createDataFrame([(x,) for x in df.columns], "column string")
            matches = rulebook.rules_for_columns(names, rule_table, 5)
        out["validations"] = cut_lineage(R.validate(out["proposals"], stats, out["totals"], matches, R.clip_counts(df, out["proposals"])))
        out["approved"] = R.approve(out["proposals"], out["validations"])
    return report


def correct_and_compare(df: DataFrame, plan: R.CorrectionPlan | None = None, dataset_id: str | None = None, **options) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(corrected table, comparison tables): scores before and after, issue types gone, columns improved."""
    ident = dataset_id or identity(df)
    totals_before, before = measure_and_check(df, ident, **options)
    plan = plan or R.plan_from_issues(before, df)
    corrected = cut_lineage(R.apply(df, plan))  # read by every check of the second round
    totals_after, after = measure_and_check(corrected, ident, **options)
    columns = columns_of(df, ident)
    scores = [scoring.column_scores(columns, x) for x in (before, after)]
    totals = [scoring.dataset_score(t, x) for t, x in ((totals_before, before), (totals_after, after))]
    return corrected, {
        "scores": R.comparison(*totals), "issue_types": R.issue_type_changes(before, after),
        "columns_improved": R.improved_columns(*scores),
    }


def analyze_files(spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
    """One result row per file: (filename, status, quality_score, issues_count, error).

    Schemas differ from file to file, so each is its own job; one bad file does not stop the others.
    """
    rows = []
    for path in paths:
        name = path.rsplit("/", 1)[-1]
        try:
            df = read_table(spark, path)
            if df.isEmpty():
                rows.append((name, "error", None, None, "the file has no rows"))
                continue
            report = run(df, "quality", **options)
            score = report.score.first()["score"]
            rows.append((name, "success", float(score), report.issues.count(), None))
        except (PySparkException, ValueError, OSError) as error:  # of the file; the result row carries it
            rows.append((name, "error", None, None, str(error).split("\n")[0][:500]))
    return spark.createDataFrame(rows, "filename string, status string, quality_score double, issues_count bigint, error string")
