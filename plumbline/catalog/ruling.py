"""Queries that match the shipped rules to columns and run every kind of them, and near-duplicates of wide rows."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.catalog.fixtures import CUSTOMERS, CUSTOMERS_SQL, as_sql, customers, derive, table
from plumbline.catalog.profiling import SEMANTIC_TYPES_SQL, fmt, number, over, stripped, union
from plumbline.operators import rulebook, rules, semantic, subwords
from plumbline.sources.readers import load_rules

CATALOGUE = str(Path(rules.__file__).parent.parent / "data" / "default_rules.json")
RULES = json.loads(Path(CATALOGUE).read_text())["rules"]


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


RULES_SQL = "(VALUES " + ", ".join(f"({quoted(r['id'])}, {quoted(r['text'])}, {quoted(r['severity'])})" for r in RULES) + ") r(rule_id, text, severity)"


def stem_sql(term: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({term}, '{p}') THEN regexp_replace({term}, '{p}', '{to.replace('$1', chr(92) + '1')}')" for p, to in subwords.STEMS) + f" ELSE {term} END"


def parts_sql(source: str, ident: str, text: str) -> str:
    """(ident, part, share) of the subwords of a text column."""
    return f"""SELECT {ident}, part, sum(share) AS share FROM (
      SELECT {ident}, '=' || s AS part, 0.5e0 AS share FROM (SELECT {ident}, {stem_sql('t')} AS s FROM (SELECT {ident}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS t FROM {source}))
      UNION ALL SELECT {ident}, substr('^' || s || '$', i, 3), 0.5e0 / length(s) FROM (SELECT {ident}, s, unnest(range(1, length(s) + 1)) AS i FROM (SELECT {ident}, {stem_sql('t')} AS s FROM (SELECT {ident}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS t FROM {source}))))
      GROUP BY ALL"""


MATCHED_SQL = f"""WITH t AS ({CUSTOMERS_SQL}), types AS ({SEMANTIC_TYPES_SQL}), asked AS (SELECT "column" AS q, regexp_replace("column", '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ' || replace(semantic_type, '_', ' ') AS question FROM types),
  rules AS (SELECT * FROM {RULES_SQL}), qp AS ({parts_sql('asked', 'q', 'question')}), dp AS (SELECT rule_id, part FROM ({parts_sql('rules', 'rule_id', 'text')})),
  f AS (SELECT part, count(*) AS df FROM dp GROUP BY part), w AS (SELECT q, part, share * (ln((1.0 + (SELECT count(*) FROM rules)) / (1.0 + coalesce(df, 0))) + 1) AS w FROM qp LEFT JOIN f USING (part)),
  s AS (SELECT w.q, rule_id, sum(w) / whole AS similarity FROM w JOIN dp USING (part) JOIN (SELECT q, sum(w) AS whole FROM w GROUP BY q) h ON h.q = w.q GROUP BY w.q, rule_id, whole)
  SELECT q AS "column", rule_id, round(similarity, 6) AS similarity, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(similarity, 12) DESC, rule_id) AS place FROM s WHERE similarity >= 0.4 - 1e-9) WHERE place <= 3"""


@query(MATCHED_SQL)
def default_rules_matched(spark, folder):
    """The shipped rules that fit the columns of the customers, by their names and business types."""
    types = semantic.semantic_types(customers(spark, folder))
    return rulebook.rules_for_columns(types, load_rules(spark, CATALOGUE)).select("column", "rule_id", F.round("similarity", 6).alias("similarity"), "place")


# The customers with dates, a foreign key and a damaged note, so that every kind of rule is broken.
K = "c_custkey"
RULED = CUSTOMERS | {
    "opened": f"CAST(concat('20', 11 + {K} % 15, '-03-0', 1 + {K} % 9) AS TIMESTAMP)",
    "closed": f"CAST(concat('20', 11 + {K} % 15 + CASE WHEN {K} % 29 = 0 THEN -1 WHEN {K} % 31 = 0 THEN 9 ELSE 1 END, '-03-0', 1 + {K} % 9) AS TIMESTAMP)",
    "nation": f"CASE WHEN {K} % 37 = 0 THEN NULL WHEN {K} % 23 = 0 THEN 1000 ELSE c_nationkey END",
    "remark": f"CASE WHEN {K} % 19 = 0 THEN 'caf\ufffd' ELSE concat('remark ', {K} % 3) END",
    "score": f"CASE WHEN {K} % 60 = 0 THEN 1000.0 ELSE CAST({K} % 10 AS DOUBLE) END",
}
RULED_SQL = as_sql(RULED, "customer")
NEAR = ["age", "segment", "code", "remark", "score", "nation", "is_active", "taux_completion", "opened", "closed"]
BINDINGS = {
    "required_fields": ["email", "note"], "missing_share": ["segment", "full_name", "nation"], "key_unique": ["customer_id", "row_key"], "near_copies": NEAR, "parent_exists": ["nation"], "end_after_start": ["closed"],
    "few_categories": ["segment", "phone", "email"], "email_shape": ["email"], "phone_signs": ["phone", "code"], "text_encoding": ["remark"], "amount_floor": ["amount"], "age_span": ["age"], "percent_span": ["taux_completion"],
    "within_deviations": ["score", "amount"], "not_in_future": ["closed"],
}
LIMITS = {"missing_share": {"limit": "0.02"}, "few_categories": {"limit": "30"}, "near_copies": {"ratio": "0.7"}}
AS_OF = "2026-01-01 00:00:00"
SEVERITY = {r["id"]: r["severity"] for r in RULES}
N = "count(*) FILTER (WHERE {})"
BLANK = "{0} IS NULL OR " + stripped("{0}") + " = ''"


def violations_sql(rule: str, column: str) -> str:
    x = column
    far = f"(SELECT count(*) FROM t, (SELECT avg({x}) AS m, stddev_samp({x}) AS s FROM t) WHERE abs({x} - m) > 3 * s)"
    over_limit = lambda n, limit: f"CASE WHEN {n} > {limit} THEN {n} ELSE 0 END"
    return {
        "required_fields": N.format(f"{x} IS NULL OR {stripped(x)} = ''"), "missing_share": over_limit(f"(count(*) - count({x}))", "0.02e0 * count(*)"), "key_unique": f"count({x}) - count(DISTINCT {x})",
        "parent_exists": N.format(f"{x} IS NOT NULL AND {x} NOT IN (SELECT n_nationkey FROM nation)"), "end_after_start": N.format("closed < opened"), "few_categories": over_limit(f"count(DISTINCT {x})", "30"),
        "email_shape": N.format(f"{x} IS NOT NULL AND NOT ({fmt(stripped(x), 'email')})"), "phone_signs": N.format(f"NOT regexp_matches({x}, '^[0-9 +\\-]+\\z')"), "text_encoding": N.format(f"contains({x}, chr(65533))"), "amount_floor": N.format(f"{x} < 0"),
        "age_span": N.format(f"NOT {x} BETWEEN 0 AND 150"), "percent_span": N.format(f"NOT {x} BETWEEN 0 AND 100"), "within_deviations": far, "not_in_future": N.format(f"{x} > TIMESTAMP '{AS_OF}'"),
    }[rule]


SAME = " + ".join(f"(a.{x} IS NOT DISTINCT FROM b.{x})::INT" for x in NEAR)
PAIRED_SQL = f"""SELECT a.*, CAST(sum(b.copies) - 1 AS BIGINT) AS partners FROM n a JOIN n b ON {SAME} >= 7 GROUP BY ALL HAVING sum(b.copies) > 1"""
NEAR_SQL = f"(SELECT coalesce(sum(copies), 0) FROM ({PAIRED_SQL}))"
ISSUES_OF_RULES_SQL = f"""WITH t AS ({RULED_SQL}), n AS (SELECT {', '.join(NEAR)}, count(*) AS copies FROM t GROUP BY ALL), v AS (
  {union([f"SELECT '{r}' AS rule_id, '{x}' AS col, '{SEVERITY[r]}' AS severity, CAST({violations_sql(r, x)} AS BIGINT) AS violations, count(*) AS total FROM t" for r, xs in BINDINGS.items() if r != 'near_copies' for x in xs])}
  UNION ALL SELECT 'near_copies', NULL, '{SEVERITY["near_copies"]}', CAST({NEAR_SQL} AS BIGINT), (SELECT count(*) FROM t))
  SELECT rule_id, col AS "column", severity, violations AS affected_count, round(100.0 * violations / total, 2) AS affected_percentage FROM v WHERE violations > 0"""


def ruled(spark, folder):
    rows = derive(table(spark, folder, "customer"), RULED)
    return rows.withColumns({x: F.col(x).cast("timestamp_ntz") for x in ("opened", "closed")})


@query(ISSUES_OF_RULES_SQL)
def default_rules_issues(spark, folder):
    """Every shipped rule, run on the customers."""
    shipped = load_rules(spark, CATALOGUE)
    for rule, params in LIMITS.items():
        shipped = shipped.withColumn("params", F.when(F.col("rule_id") == rule, F.create_map(*[F.lit(x) for kv in params.items() for x in kv])).otherwise(F.col("params")))
    found = rulebook.run_rules(ruled(spark, folder), shipped, BINDINGS, as_of=AS_OF, starts={"closed": "opened"}, parents={"nation": (table(spark, folder, "nation"), "n_nationkey")})
    return found.select("rule_id", "column", "severity", "affected_count", "affected_percentage")


@query(f"WITH t AS ({RULED_SQL}), n AS (SELECT {', '.join(NEAR)}, count(*) AS copies FROM t GROUP BY ALL) SELECT copies, partners, count(*) AS n FROM ({PAIRED_SQL}) GROUP BY ALL")
def near_duplicates_wide(spark, folder):
    """Customers that agree on seven of ten columns, met on blocks of columns: how many rows have how many partners."""
    rows = rules.near_duplicates(ruled(spark, folder), [], NEAR, 0.7, most_subsets=0)
    return rows.groupBy("copies", "partners").agg(F.count(F.lit(1)).alias("n"))
