"""Whole runs over tables and files."""

from __future__ import annotations


from plumbline.catalog import query
from plumbline.catalog.fixtures import CUSTOMERS_SQL, customers
from plumbline.catalog.checking import FORMAT_SQL, IDENTIFIER_SQL, MISSING_SQL, MIXED_SQL, PSEUDO_SQL, SEMANTIC_CHECKS_SQL, flat
from plumbline.catalog.profiling import over, union
from plumbline.plans import analysis


@query(over(CUSTOMERS_SQL, union([MISSING_SQL, PSEUDO_SQL, MIXED_SQL, FORMAT_SQL, IDENTIFIER_SQL, SEMANTIC_CHECKS_SQL])))
def full_issue_table(spark, folder):
    """Every standard check and the duplicate-row check; the rows are distinct by their key."""
    return flat(analysis.find_issues(customers(spark, folder)))


@query()
def full_run(spark, folder):
    """Profile, issues, proposals and verdicts; the verdicts are returned."""
    report = analysis.run(customers(spark, folder), "full")
    return report.approved.join(report.validations.select("proposal_id", "status"), "proposal_id").select("column", "correction_type", "rows_affected", "confidence", "is_approved", "status")


@query()
def corrected_and_compared(spark, folder):
    _, tables = analysis.correct_and_compare(customers(spark, folder), checks=["missing_values", "pseudo_nulls", "mixed_types", "format"])
    return tables["scores"]


@query("SELECT * FROM (VALUES ('customer.parquet', 'success'), ('orders.parquet', 'success'), ('absent.parquet', 'error')) v(filename, status)")
def analyzed_files(spark, folder):
    """One result row per file; a missing file does not stop the others."""
    rows = analysis.analyze_files(spark, [f"{folder}/{n}.parquet" for n in ("customer", "orders", "absent")])
    return rows.select("filename", "status")


