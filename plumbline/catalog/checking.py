"""Quality-check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.catalog.fixtures import CUSTOMERS, CUSTOMERS_SQL, SEMANTIC_SQL, as_sql, customers, derive, semantic, table
from plumbline.catalog.profiling import CUSTOMER_TEXT, SEMANTIC_TYPES_SQL, fmt, number, over, pseudo, quote, stripped, union
from plumbline.functions import constants as K
from plumbline.functions import predicates as P
from plumbline.operators import checks as C
from plumbline.operators import evidence as E
from plumbline.operators import metrics, rules, similarity
from plumbline.operators import profile as prof

FLAT = ["rule_id", "issue_type", "severity", "column", "affected_count", "affected_percentage", "confidence"]


def flat(rows):
    return rows.select(*FLAT)


def issue_sql(body: str, rule: str, kind: str, severity: str, share: str, confidence: str = "0.9", where: str = "n > 0") -> str:
    """``body`` yields column, n, total and what the expressions use."""
    return (f"SELECT '{rule}' AS rule_id, '{kind}' AS issue_type, {severity} AS severity, \"column\", CAST(n AS BIGINT) AS affected_count, "
            f"CAST({share} AS DOUBLE) AS affected_percentage, CAST({confidence} AS DOUBLE) AS confidence FROM ({body}) WHERE {where}")


def per_column(columns, n: str, total: str = "count(*)", extra: str = "") -> str:
    """One row per column; {c} in the templates is the column."""
    return union([
        f"SELECT '{c}' AS \"column\", {n.format(c=c)} AS n, {total.format(c=c)} AS total{extra.format(c=c)} FROM t" for c in columns
    ])


PERCENT = "round(100.0 * n / total, 2)"
STEPS = "CASE WHEN {s} > {a} THEN 'high' WHEN {s} > {b} THEN 'medium' ELSE 'low' END"

MISSING_SQL = issue_sql(
    per_column(CUSTOMERS, "count(*) - count({c})"), "missing_values", "missing_values",
    "CASE WHEN n / CAST(total AS DOUBLE) >= 0.3 THEN 'high' WHEN n / CAST(total AS DOUBLE) >= 0.1 THEN 'medium' ELSE 'low' END",
    PERCENT, "0.95", "n / CAST(total AS DOUBLE) >= 0.01")


@query(over(CUSTOMERS_SQL, MISSING_SQL))
def missing_values(spark, folder):
    return flat(C.column_issues(customers(spark, folder), ["missing_values"]))


NAN_SQL = "SELECT l_orderkey AS k, CASE WHEN l_linenumber = 1 THEN CAST('nan' AS DOUBLE) WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS q FROM lineitem"


@query(f"WITH t AS ({NAN_SQL}) SELECT count(*) FILTER (WHERE q IS NULL OR isnan(q)) AS missing, count(*) FILTER (WHERE NOT isnan(q)) AS present, "
       "round(avg(q) FILTER (WHERE NOT isnan(q)), 6) AS mean FROM t")
def missing_with_nan(spark, folder):
    q = F.expr("CASE WHEN l_linenumber = 1 THEN double('nan') WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END")
    rows = metrics.column_metrics(table(spark, folder, "lineitem").select(q.alias("q")), None, ["mean"])
    return rows.select((F.col("n_rows") - F.col("n_values")).alias("missing"), F.col("n_values").alias("present"), F.round("mean", 6).alias("mean"))


PSEUDO_SQL = issue_sql(per_column(CUSTOMER_TEXT, "count(*) FILTER (WHERE " + pseudo("{c}") + ")"), "pseudo_nulls", "missing_values",
                       STEPS.format(s=PERCENT, a=30, b=10), PERCENT, "0.92")


@query(over(CUSTOMERS_SQL, PSEUDO_SQL))
def pseudo_nulls(spark, folder):
    return flat(C.column_issues(customers(spark, folder), ["pseudo_nulls"]))


@query(over(CUSTOMERS_SQL, union([
    f"SELECT '{c}' AS \"column\", token, n, CAST(place AS INT) AS place FROM (SELECT {c} AS token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS place FROM t WHERE {pseudo(c)} GROUP BY {c}) WHERE place <= 5"
    for c in CUSTOMER_TEXT])))
def pseudo_null_tokens(spark, folder):
    return C.pseudo_null_tokens(customers(spark, folder))


MIXED_SQL = issue_sql(per_column(CUSTOMER_TEXT, "count({c}) - count(" + number("{c}").replace("{1,2}", "{{1,2}}") + ")", "count({c})", ", count(" + number("{c}") + ") AS numbers"),
                      "mixed_types", "type_mismatch", "'medium'", PERCENT, "0.85", "numbers > 0 AND numbers < 0.9 * total")


@query(over(CUSTOMERS_SQL, MIXED_SQL))
def mixed_types(spark, folder):
    return flat(C.column_issues(customers(spark, folder), ["mixed_types"]))


@query(over(CUSTOMERS_SQL, f"SELECT row_key, code AS value FROM t WHERE code IS NOT NULL AND {number('code')} IS NULL ORDER BY row_key LIMIT 10"))
def mixed_type_samples(spark, folder):
    return C.examples(customers(spark, folder), ["row_key"], "code", C.not_a_number("code"), 10)


@query(over(CUSTOMERS_SQL, union([
    f"(SELECT 'email_hidden' AS predicate, row_key FROM t WHERE {pseudo('email')} ORDER BY row_key LIMIT 100)",
    "(SELECT 'age_missing', row_key FROM t WHERE age IS NULL ORDER BY row_key LIMIT 100)"])))
def affected_row_keys(spark, folder):
    """The keys of the first hundred rows behind an issue."""
    return C.affected_rows(customers(spark, folder), ["row_key"], {
        "email_hidden": P.col(P.is_pseudo_null("email")), "age_missing": F.col("age").isNull()})


@query(over(CUSTOMERS_SQL, f"SELECT count({number('code')}) AS numbers, count(code) AS present, round(sum({number('code')}), 4) AS total FROM t"))
def numeric_text(spark, folder):
    return customers(spark, folder).select(P.col(P.to_number("code")).alias("x"), "code").agg(
        F.count("x").alias("numbers"), F.count("code").alias("present"), F.round(F.sum("x"), 4).alias("total"))


DUPLICATE_COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linenumber"]
_DUP = ", ".join(DUPLICATE_COLUMNS)


@query(f"""WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY {_DUP} HAVING count(*) > 1), s AS (SELECT CAST(sum(n) AS BIGINT) AS d, count(*) AS groups FROM g)
  SELECT 'duplicate_rows' AS rule_id, d AS affected_count, round(100.0 * d / (SELECT count(*) FROM lineitem), 2) AS affected_percentage,
  CAST((SELECT count(*) FROM lineitem) - d + groups AS VARCHAR) AS unique_rows,
  CASE WHEN 100.0 * d / (SELECT count(*) FROM lineitem) > 10 THEN 'high' WHEN 100.0 * d / (SELECT count(*) FROM lineitem) > 1 THEN 'medium' ELSE 'low' END AS severity FROM s WHERE d > 0""")
def duplicate_rows(spark, folder):
    rows = C.duplicate_rows(table(spark, folder, "lineitem"), DUPLICATE_COLUMNS)
    return rows.select("rule_id", "affected_count", "affected_percentage", F.element_at("details", "unique_rows").alias("unique_rows"), "severity")


@query("""WITH t AS (SELECT text, lang, source FROM documents), g AS (SELECT count(*) AS n FROM t GROUP BY text, lang, source HAVING count(*) > 1)
  SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_count, count(*) AS groups, (SELECT count(*) FROM t) AS row_count FROM g""")
def duplicate_documents(spark, folder):
    return C.duplicate_counts(table(spark, folder, "documents"), ["text", "lang", "source"])


FORMAT_OF = {"email": "email", "phone": "phone", "code_postal": "postal", "siret": "siret"}
FORMAT_SQL = issue_sql(
    union([f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE NOT ({pseudo(c)}) AND NOT {fmt(stripped(c), f)}) AS n, count(*) FILTER (WHERE NOT ({pseudo(c)})) AS total FROM t"
           for c, f in FORMAT_OF.items()]),
    "format", "format_error", STEPS.format(s=PERCENT, a=50, b=20), PERCENT, "0.87", f"n > 0 AND {PERCENT} >= 5")


@query(over(CUSTOMERS_SQL, FORMAT_SQL))
def wrong_formats(spark, folder):
    return flat(C.column_issues(customers(spark, folder), ["format"]))


@query("SELECT count(*) FILTER (WHERE regexp_matches(url, " + quote(K.FORMATS["url"]) + ")) AS valid, count(*) AS total, CAST(sum(CASE WHEN regexp_matches(url, '^https://') THEN 1 ELSE 0 END) AS BIGINT) AS secure FROM pages")
def page_urls(spark, folder):
    rows = table(spark, folder, "pages").select("url", P.col(P.has_format("url", "url")).alias("ok"))
    return rows.agg(F.count_if("ok").alias("valid"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("url").rlike("^https://")).alias("secure"))


def repeats_sql(c: str, t: str) -> str:
    return f"(SELECT count(*) - count(DISTINCT {c}) - CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END FROM {t})"


IDENTIFIER_SQL = issue_sql(f"SELECT 'customer_id' AS \"column\", {repeats_sql('customer_id', 't')} AS n, (SELECT count(*) FROM t) AS total",
                           "unique_identifier", "constraint_violation", "'high'", PERCENT, "0.9")


@query(over(CUSTOMERS_SQL, IDENTIFIER_SQL))
def identifier_repeats(spark, folder):
    return flat(C.column_issues(customers(spark, folder), ["unique_identifier"]))


@query(f"SELECT 'l_orderkey' AS \"column\", {repeats_sql('l_orderkey', 'lineitem')} AS repeats UNION ALL SELECT 'l_partkey', {repeats_sql('l_partkey', 'lineitem')}")
def key_repeats(spark, folder):
    rows = table(spark, folder, "lineitem")
    m = metrics.with_distinct(metrics.column_metrics(rows, ["l_orderkey", "l_partkey"], []), rows, ["l_orderkey", "l_partkey"])
    return m.select("column", C.repeats().cast("bigint").alias("repeats"))


SEMANTIC_CHECKS_SQL = union([
    issue_sql("SELECT 'amount' AS \"column\", count(*) FILTER (WHERE amount < 0) AS n, count(*) AS total FROM t", "negative_amount", "anomaly", "'medium'", PERCENT, "0.62"),
    issue_sql("SELECT 'taux_completion' AS \"column\", count(*) FILTER (WHERE taux_completion < 0 OR taux_completion > 100) AS n, count(*) AS total FROM t", "percentage_range", "anomaly", "'medium'", PERCENT, "0.75"),
    issue_sql("SELECT 'age' AS \"column\", count(*) FILTER (WHERE age < 0 OR age > 150) AS n, count(*) AS total FROM t", "age_range", "anomaly", "'medium'", PERCENT, "0.75"),
    issue_sql(union([f"SELECT s.\"column\" AS \"column\", (SELECT count(*) FILTER (WHERE NOT {fmt(c, f)}) FROM t) AS n, (SELECT count(*) FROM t) AS total, s.confidence AS k FROM ({SEMANTIC_TYPES_SQL}) s WHERE s.\"column\" = '{c}' AND s.semantic_type = '{kind}'"
                     for c, f, kind in [("email", "email", "email"), ("phone", "phone", "phone"), ("code_postal", "postal", "postal_code")]]),
              "semantic_format", "format_error", "'medium'", PERCENT, "round(k * 0.9, 3)", "100.0 * n / total >= 5"),
])


@query(over(CUSTOMERS_SQL, SEMANTIC_CHECKS_SQL))
def semantic_value_checks(spark, folder):
    return flat(C.column_issues(customers(spark, folder), ["negative_amount", "percentage_range", "age_range", "semantic_format"]))


@query(over(CUSTOMERS_SQL, union([MISSING_SQL, PSEUDO_SQL, MIXED_SQL, FORMAT_SQL, IDENTIFIER_SQL, SEMANTIC_CHECKS_SQL])))
def issue_report(spark, folder):
    """All column checks of a table in one go."""
    return flat(C.column_issues(customers(spark, folder)))


# Rules

RULES = [
    ("rule_required", "age and email columns are required: not null", "constraint", "critical", "completeness", True),
    ("rule_unique", "customer id must be unique", "constraint", "critical", "uniqueness", True),
    ("rule_key", "siret is a primary key with strict format", "format", "high", "validity", True),
    ("rule_optional", "full name is nullable", "constraint", "low", "completeness", True),
    ("rule_off", "segment must be unique and required", "constraint", "high", "uniqueness", False),
]


def rule_table(spark):
    return spark.createDataFrame(RULES, "rule_id string, text string, rule_type string, severity string, category string, active boolean")


MATCHES = [("age", "rule_required", 0.81), ("email", "rule_required", 0.72), ("customer_id", "rule_unique", 0.9), ("siret", "rule_key", 0.6), ("full_name", "rule_optional", 0.66), ("phone", "rule_unique", 0.4)]


def matched(spark):
    m = spark.createDataFrame(MATCHES, "column string, rule_id string, similarity double")
    return m.where(P.relevant(F.col("similarity"))).join(rules.active_rules(rule_table(spark)).drop("active"), "rule_id")


@query(over(CUSTOMERS_SQL, union([
    issue_sql(f"SELECT 'customer_id' AS \"column\", {repeats_sql('customer_id', 't')} AS n, (SELECT count(*) FROM t) AS total", "rule_unique", "constraint_violation", "'critical'", PERCENT, "0.9"),
    issue_sql("SELECT 'age' AS \"column\", count(*) - count(age) AS n, count(*) AS total FROM t", "rule_required", "constraint_violation", "'critical'", PERCENT, "0.81"),
    issue_sql("SELECT 'email' AS \"column\", count(*) - count(email) AS n, count(*) AS total FROM t", "rule_required", "constraint_violation", "'critical'", PERCENT, "0.72")])))
def rule_violations(spark, folder):
    df = customers(spark, folder)
    rows = metrics.with_distinct(metrics.column_metrics(df, None, []), df)
    return flat(rules.rule_issues(rows, matched(spark)))


@query(over(CUSTOMERS_SQL, union([
    issue_sql("SELECT 'age' AS \"column\", count(*) - count(age) AS n, count(*) AS total FROM t", "missing_values", "missing_values", "'high'", PERCENT, "0.95", "n / CAST(total AS DOUBLE) >= 0.01"),
    issue_sql("SELECT 'email' AS \"column\", count(*) - count(email) AS n, count(*) AS total FROM t", "missing_values", "missing_values", "'high'", PERCENT, "0.95", "n / CAST(total AS DOUBLE) >= 0.01"),
    issue_sql("SELECT 'full_name' AS \"column\", count(*) - count(full_name) AS n, count(*) AS total FROM t", "missing_values", "missing_values", "'high'", PERCENT, "0.95", "n / CAST(total AS DOUBLE) >= 0.8"),
    issue_sql(per_column([c for c in CUSTOMERS if c not in ("age", "email", "full_name")], "count(*) - count({c})"), "missing_values", "missing_values",
              "CASE WHEN n / CAST(total AS DOUBLE) >= 0.3 THEN 'high' WHEN n / CAST(total AS DOUBLE) >= 0.1 THEN 'medium' ELSE 'low' END", PERCENT, "0.95", "n / CAST(total AS DOUBLE) >= 0.01")])))
def missing_values_with_overrides(spark, folder):
    overrides = rules.overrides_from_rules(matched(spark))
    return flat(C.column_issues(customers(spark, folder), ["missing_values"], overrides=overrides))


PART_TEXT = {"query": "concat(p_name, ' ', p_type)", "name": "p_name"}
TFIDF_SQL = """WITH q0 AS (SELECT DISTINCT concat(p_name, ' ', p_type) AS q FROM part), d0 AS (SELECT DISTINCT p_name AS d FROM part),
  qt AS (SELECT q, term, count(*) AS tf FROM (SELECT q, unnest(string_split(lower(q), ' ')) AS term FROM q0) GROUP BY q, term),
  dt AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(string_split(lower(d), ' ')) AS term FROM d0) GROUP BY d, term),
  f AS (SELECT term, count(*) AS df FROM dt GROUP BY term), n AS (SELECT count(*) AS n FROM d0),
  qw AS (SELECT q, term, tf * (ln((1.0 + n) / (1.0 + coalesce(df, 0))) + 1) AS w FROM qt LEFT JOIN f USING (term), n),
  dw AS (SELECT d, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM dt JOIN f USING (term), n),
  qn AS (SELECT q, sqrt(sum(w * w)) AS norm FROM qw GROUP BY q), dn AS (SELECT d, sqrt(sum(w * w)) AS norm FROM dw GROUP BY d),
  s AS (SELECT q, d, sum(qw.w / qn.norm * dw.w / dn.norm) AS sim FROM qw JOIN qn USING (q) JOIN dw USING (term) JOIN dn USING (d) GROUP BY q, d)
  SELECT q AS "column", d AS rule_id, round(sim, 6) AS similarity, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sim, 12) DESC, d) AS place FROM s WHERE sim >= 0.55) WHERE place <= 3"""


@query(TFIDF_SQL)
def matched_rules(spark, folder):
    """The catalogue names most like each part description, as rules are matched to columns."""
    parts = table(spark, folder, "part")
    asked = parts.select(F.concat_ws(" ", "p_name", "p_type").alias("column")).distinct()
    names = parts.select(F.col("p_name").alias("rule_id"), F.col("p_name").alias("text")).distinct().withColumns(
        {"rule_type": F.lit("constraint"), "severity": F.lit("low"), "category": F.lit("name"), "active": F.lit(True)})
    rows = rules.match_rules(asked, names, 3, 0.55, query=F.col("column"))
    return rows.select("column", "rule_id", F.round("similarity", 6).alias("similarity"), "place")


@query("""WITH r AS (SELECT DISTINCT p_name AS rule_id, CASE WHEN length(p_type) % 2 = 0 THEN 'uniqueness' ELSE 'validity' END AS category,
    CASE WHEN p_size % 4 = 0 THEN 'low' WHEN p_size % 4 = 1 THEN 'medium' WHEN p_size % 4 = 2 THEN 'high' ELSE 'critical' END AS severity FROM part WHERE p_size % 5 <> 0)
  SELECT category, count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'critical') AS critical FROM r GROUP BY category""")
def rules_by_category(spark, folder):
    rows = table(spark, folder, "part").selectExpr(
        "p_name AS rule_id", "CASE WHEN length(p_type) % 2 = 0 THEN 'uniqueness' ELSE 'validity' END AS category",
        "CASE WHEN p_size % 4 = 0 THEN 'low' WHEN p_size % 4 = 1 THEN 'medium' WHEN p_size % 4 = 2 THEN 'high' ELSE 'critical' END AS severity", "p_size % 5 <> 0 AS active")
    return rules.rules_by_category(rows.distinct())


ORDER_DATES = {"o_orderkey": "o_orderkey", "started": "o_orderdate", "ended": "CASE WHEN o_orderkey % 13 = 0 THEN TIMESTAMP '1990-01-01 00:00:00' ELSE o_orderdate END",
               "amount": "CASE WHEN o_orderkey % 21 = 0 THEN -o_totalprice ELSE o_totalprice END",
               "phone": "CASE WHEN o_orderkey % 8 = 0 THEN '01-AB' WHEN o_orderkey % 8 = 1 THEN NULL ELSE '+33 1-23' END",
               "label": "CASE WHEN o_orderkey % 10 = 0 THEN ' ' WHEN o_orderkey % 10 = 1 THEN NULL ELSE o_orderpriority END"}
DAMAGED = "concat('caf', chr(65533))"
_O = as_sql(ORDER_DATES, "orders")


@query(over(_O, union([
    "SELECT 'end_after_start' AS rule_id, count(*) FILTER (WHERE ended < started) AS violations, count(*) AS row_count FROM t",
    "SELECT 'amount_positive', count(*) FILTER (WHERE amount < 0), count(*) FROM t",
    "SELECT 'phone_characters', count(*) FILTER (WHERE NOT regexp_matches(phone, '^[0-9 +\\-]+\\z')), count(*) FROM t",
    "SELECT 'future', count(*) FILTER (WHERE started > TIMESTAMP '2000-01-01 00:00:00'), count(*) FROM t",
    "SELECT 'required_label', count(*) FILTER (WHERE label IS NULL OR trim(label) = ''), count(*) FROM t"])))
def row_rules(spark, folder):
    """Rules over the rows of a table, all counted in one scan."""
    columns = {k: v.replace("TIMESTAMP '", "TIMESTAMP_NTZ '") for k, v in ORDER_DATES.items()}
    return rules.count_violations(derive(table(spark, folder, "orders"), columns), {
        "end_after_start": rules.ends_before_start("started", "ended"), "amount_positive": rules.negative("amount"),
        "phone_characters": rules.bad_phone_characters("phone"), "future": rules.in_the_future("started", "2000-01-01 00:00:00"),
        "required_label": rules.required_but_blank("label"),
    })


@query("SELECT 'encoding' AS rule_id, count(*) FILTER (WHERE contains(CASE WHEN doc_id % 12 = 0 THEN concat(text, chr(65533)) ELSE text END, chr(65533))) AS violations, count(*) AS row_count FROM documents")
def corrupt_text(spark, folder):
    damaged = F.expr("CASE WHEN doc_id % 12 = 0 THEN concat(text, '\\ufffd') ELSE text END")
    return rules.count_violations(table(spark, folder, "documents").select(damaged.alias("text")), {"encoding": rules.corrupt_text("text")})


@query(over(CUSTOMERS_SQL, union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count FROM t HAVING count(DISTINCT {c}) > 1000" for c in CUSTOMERS])))
def high_cardinality(spark, folder):
    return rules.high_cardinality(prof.column_counts(customers(spark, folder)))


@query("SELECT event_id, value, round((value - m) / s, 6) AS z_score FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) WHERE abs((value - m) / s) > 3")
def beyond_three_deviations(spark, folder):
    return rules.beyond_deviations(table(spark, folder, "events"), "value", ["event_id"]).withColumn("z_score", F.round("z_score", 6))


@query("SELECT key, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 17 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS key FROM orders) WHERE key IS NOT NULL AND key NOT IN (SELECT c_custkey FROM customer) GROUP BY key")
def orphan_keys(spark, folder):
    child = table(spark, folder, "orders").selectExpr("CASE WHEN o_orderkey % 17 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS fk")
    return rules.orphans(child, table(spark, folder, "customer"), "fk", "c_custkey")


NEAR = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]


@query("""
  WITH r AS (SELECT l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, count(*) AS copies FROM lineitem GROUP BY ALL)
  SELECT a.l_suppkey, a.l_quantity, a.l_discount, a.l_tax, a.l_returnflag, a.copies, CAST(sum(b.copies) - 1 AS BIGINT) AS partners
  FROM r a JOIN r b ON a.l_suppkey = b.l_suppkey
    AND (a.l_quantity = b.l_quantity)::INT + (a.l_discount = b.l_discount)::INT + (a.l_tax = b.l_tax)::INT + (a.l_returnflag = b.l_returnflag)::INT >= 3
  GROUP BY a.l_suppkey, a.l_quantity, a.l_discount, a.l_tax, a.l_returnflag, a.copies HAVING sum(b.copies) > 1""")
def near_duplicate_rows(spark, folder):
    """Order lines of one supplier that agree on three of four columns."""
    return rules.near_duplicates(table(spark, folder, "lineitem"), ["l_suppkey"], NEAR, 0.75)


@query("""SELECT label, vec_id, round(sim, 5) AS similarity, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(sim, 12) DESC, vec_id) AS place FROM (
  SELECT q.label, e.vec_id, list_cosine_similarity(q.v, CAST(e.embedding AS DOUBLE[])) AS sim FROM (
    SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label) q, embeddings e)) WHERE place <= 3""")
def nearest_vectors(spark, folder):
    """The three vectors nearest to the centre of each label."""
    e = table(spark, folder, "embeddings")
    cells = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))
    rows = similarity.vector_top_k(centres, e, "label", "v", "vec_id", "embedding", 3)
    return rows.withColumn("similarity", F.round("similarity", 5))


_EVIDENCE = {
    ("missing_values", "age"): "age IS NULL", ("missing_values", "email"): "email IS NULL", ("missing_values", "full_name"): "full_name IS NULL",
    ("pseudo_nulls", "email"): pseudo("email"), ("pseudo_nulls", "segment"): pseudo("segment"), ("pseudo_nulls", "note"): pseudo("note"),
    ("mixed_types", "code"): f"code IS NOT NULL AND {number('code')} IS NULL",
    ("format", "email"): f"email IS NOT NULL AND NOT {pseudo('email')} AND NOT {fmt(stripped('email'), 'email')}",
    ("format", "phone"): f"phone IS NOT NULL AND NOT {pseudo('phone')} AND NOT {fmt(stripped('phone'), 'phone')}",
}


@query(over(CUSTOMERS_SQL, union([
    f"""SELECT '{rule}' AS rule_id, '{x}' AS "column", (SELECT count(*) FROM t WHERE {where}) AS affected_count, array_to_string(list(row_key ORDER BY row_key), ',') AS row_keys,
    coalesce(array_to_string(list_filter(list(coalesce(CAST({x} AS VARCHAR), '') ORDER BY row_key)[1:10], lambda v: true), '|'), '') AS samples FROM (SELECT row_key, {x} FROM t WHERE {where} ORDER BY row_key LIMIT 100) HAVING count(*) > 0"""
    for (rule, x), where in _EVIDENCE.items()])))
def issues_with_evidence(spark, folder):
    """Issues of the customers with the keys of the first hundred rows and the first ten values behind each, all from one scan."""
    rows = customers(spark, folder)
    wanted = spark.createDataFrame(list(_EVIDENCE), "rule_id string, column string")
    found = C.column_issues(rows, ["missing_values", "pseudo_nulls", "mixed_types", "format"]).join(wanted, ["rule_id", "column"])
    shown = E.with_evidence(found, E.evidence(rows, found, ["row_key"]), ["row_key"])
    keys = F.array_join(F.transform("row_keys", lambda k: k["row_key"].cast("string")), ",")
    return shown.select("rule_id", "column", "affected_count", keys.alias("row_keys"), F.array_join(F.transform("samples", lambda v: F.coalesce(v, F.lit(""))), "|").alias("samples"))
