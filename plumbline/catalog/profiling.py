"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.catalog.fixtures import CUSTOMERS, CUSTOMERS_SQL, customers, table
from plumbline.functions import constants as K
from plumbline.operators import correlation, metrics, semantic
from plumbline.operators import profile as P

EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CUSTOMER_TEXT = ["full_name", "email", "phone", "code_postal", "siret", "code", "segment", "signup", "is_active", "note"]
SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(quote(w) for w in words) + ")"


def stripped(c: str) -> str:
    return f"trim({c}, {SPACE})"


def pseudo(c: str) -> str:
    return f"lower({stripped(c)}) IN {in_list(K.PSEUDO_NULLS)}"


def fmt(c: str, name: str) -> str:
    return f"regexp_matches({c}, {quote(K.FORMATS[name])})"


def number(c: str) -> str:
    s = stripped(c)
    return (f"CASE WHEN regexp_matches({s}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\z') THEN try_cast({s} AS DOUBLE) "
            f"WHEN regexp_matches(lower({s}), '^[+-]?(inf|infinity)\\z') THEN CAST('inf' AS DOUBLE) END")


def plain_date(c: str) -> str:
    """A date of the layouts that can be read one way only, null otherwise."""
    s = stripped(c)
    yf = r"'^([0-9]{4})[/.]([0-9]{1,2})[/.]([0-9]{1,2})\z'"
    iso = r"'^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?\z'"
    compact = r"'^((19|20)[0-9]{2})([0-9]{2})([0-9]{2})(T[0-9]{6}Z?)?\z'"
    names = "(jan|january|feb|february|mar|march|apr|april|may|jun|june|jul|july|aug|august|sep|sept|september|oct|october|nov|november|dec|december)"
    m_first, d_first = rf"'^{names}\.? ([0-9]{{1,2}}),? ([0-9]{{4}})\z'", rf"'^([0-9]{{1,2}})[ -]{names}\.?[ -]([0-9]{{4}})\z'"

    def ymd(y: str, m: str, d: str) -> str:
        return f"try_cast({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"

    def month(name: str) -> str:
        return f"CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', left({name}, 3)) + 2) // 3 AS VARCHAR)"

    def part(x: str, pattern: str, i: int) -> str:
        return f"regexp_extract({x}, {pattern}, {i})"

    low = f"lower({s})"
    return (f"(CASE WHEN regexp_matches({s}, {iso}) THEN try_cast(regexp_extract({s}, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') AS DATE) "
            f"WHEN regexp_matches({s}, {yf}) THEN {ymd(part(s, yf, 1), part(s, yf, 2), part(s, yf, 3))} "
            f"WHEN regexp_matches({s}, {compact}) THEN {ymd(part(s, compact, 1), part(s, compact, 3), part(s, compact, 4))} "
            f"WHEN regexp_matches({low}, {m_first}) THEN {ymd(part(low, m_first, 3), month(part(low, m_first, 1)), part(low, m_first, 2))} "
            f"WHEN regexp_matches({low}, {d_first}) THEN {ymd(part(low, d_first, 3), month(part(low, d_first, 2)), part(low, d_first, 1))} END)")


def numeric_date(c: str, day_first: bool) -> str:
    s = stripped(c)
    a, b, year = (rf"regexp_extract({s}, '^([0-9]{{1,2}})[/.\-]([0-9]{{1,2}})[/.\-]([0-9]{{4}})\z', {i})" for i in (1, 2, 3))
    m, d = (b, a) if day_first else (a, b)
    return f"try_cast({year} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"


def is_date(c: str) -> str:
    return f"(coalesce({plain_date(c)}, {numeric_date(c, True)}, {numeric_date(c, False)}) IS NOT NULL)"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def over(source: str, body: str) -> str:
    return f"WITH t AS ({source}) {body}"


def counts_sql(columns: list[str], source: str = "t") -> str:
    return union([
        f"SELECT '{c}' AS \"column\", count(\"{c}\") AS count, count(*) - count(\"{c}\") AS null_count, "
        f"round(100.0 * (count(*) - count(\"{c}\")) / count(*), 2) AS null_percentage, count(DISTINCT \"{c}\") AS unique_count, "
        f"round(100.0 * count(DISTINCT \"{c}\") / count(*), 2) AS unique_percentage FROM {source}" for c in columns
    ])


@query(counts_sql(EVENT_COLUMNS, "events"))
def column_counts(spark, folder):
    return P.column_counts(table(spark, folder, "events"))


@query(over(CUSTOMERS_SQL, counts_sql(list(CUSTOMERS))))
def column_counts_with_nulls(spark, folder):
    return P.column_counts(customers(spark, folder))


def summary_sql(columns: list[str], source: str) -> str:
    return union([
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75 FROM {source}"
        for c in columns
    ])


@query(summary_sql(LINE_NUMBERS, "lineitem"))
def numeric_summary(spark, folder):
    rows = P.numeric_summary(table(spark, folder, "lineitem"), LINE_NUMBERS)
    return rows.select(
        "column", "count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max",
        *[F.round(F.get("quantiles", F.lit(i)), 6).alias(q) for i, q in enumerate(["q25", "q50", "q75"])],
    )


@query(over(CUSTOMERS_SQL, "SELECT count(*) AS row_count, %d AS column_count, %s AS total_null_count FROM t" % (
    len(CUSTOMERS), "CAST(" + " + ".join(f"count(*) - count({c})" for c in CUSTOMERS) + " AS BIGINT)")))
def table_totals(spark, folder):
    return P.table_totals(metrics.column_metrics(customers(spark, folder), None, [])).drop("size_bytes")


@query(over(CUSTOMERS_SQL, union([
    f"(SELECT '{c}' AS \"column\", row_key, CAST({c} AS VARCHAR) AS value FROM t WHERE {c} IS NOT NULL ORDER BY row_key LIMIT 5)" for c in ("full_name", "age", "email")])))
def sample_values(spark, folder):
    rows = P.sample_values(customers(spark, folder), ["row_key"], ["full_name", "age", "email"])
    return rows.withColumnRenamed("_k0", "row_key")


def inferred_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", CASE WHEN count({c}) = 0 THEN 'empty'
      WHEN count(DISTINCT {c}) < 50 OR count(DISTINCT {c}) / CAST(count({c}) AS DOUBLE) < 0.05 THEN 'categorical'
      WHEN count(*) FILTER (WHERE {is_date(c)}) = count({c}) THEN 'datetime_string'
      WHEN avg(length({c})) > 100 THEN 'text_long' WHEN avg(length({c})) > 30 THEN 'text_short'
      WHEN count(DISTINCT {c}) = count({c}) THEN 'identifier' ELSE 'categorical_high_cardinality' END AS inferred_type FROM t"""


@query(over(CUSTOMERS_SQL, union([inferred_sql(c) for c in CUSTOMER_TEXT] + [
    f"SELECT '{c}', '{t}'" for c, t in [("row_key", "integer"), ("customer_id", "integer"), ("age", "integer"), ("taux_completion", "float"), ("amount", "float")]])))
def technical_types(spark, folder):
    return P.profile(customers(spark, folder)).select("column", "inferred_type")


@query(over("SELECT doc_id, text, lang, source, n_chars FROM documents", union([inferred_sql(c) for c in ("text", "lang", "source")])))
def technical_types_of_documents(spark, folder):
    return P.profile(table(spark, folder, "documents"), ["text", "lang", "source"]).select("column", "inferred_type")


@query(union([f"SELECT '{c}' AS \"column\", round(avg(length({c})), 6) AS avg_length FROM documents" for c in ("text", "lang", "source")]))
def mean_text_length(spark, folder):
    rows = metrics.column_metrics(table(spark, folder, "documents"), ["text", "lang", "source"], ["avg_length"])
    return rows.select("column", F.round("avg_length", 6).alias("avg_length"))


def top_sql(c: str, k: int, source: str) -> str:
    return f"""SELECT '{c}' AS "column", CAST(place AS INT) AS place, value, n FROM (
      SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS place
      FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE place <= {k}"""


@query(union([top_sql(c, 5, "part") for c in ("p_name", "p_brand", "p_type")]))
def mode_and_top_values(spark, folder):
    return P.frequent_values(table(spark, folder, "part"), ["p_name", "p_brand", "p_type"])


@query(union([f"""SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM {t}) AS unique_values, CAST(place AS INT) AS place, value, n, round(n / CAST((SELECT count({c}) FROM {t}) AS DOUBLE), 6) AS share
    FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS place FROM {t} GROUP BY {c}) WHERE place <= 10"""
    for c, t in [("o_orderpriority", "orders"), ("o_orderstatus", "orders")]]))
def category_distribution(spark, folder):
    rows = P.category_distribution(table(spark, folder, "orders"), ["o_orderpriority", "o_orderstatus"])
    return rows.withColumn("share", F.round("share", 6))


@query(union([f"SELECT '{c}' AS \"column\", CAST(coalesce(sum(strlen({c})), 0) AS BIGINT) AS size_bytes FROM documents" for c in ("text", "lang", "source")]
             + ["SELECT 'doc_id', 8 * count(doc_id) FROM documents", "SELECT 'n_chars', 8 * count(n_chars) FROM documents"]))
def size_estimate(spark, folder):
    return P.size_estimate(table(spark, folder, "documents"))


PAIRS = [(a, b) for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[i + 1:]]


def label_sql(r: str) -> str:
    return (f"CASE WHEN {r} > 0 THEN 'positive' ELSE 'negative' END AS direction, CASE WHEN abs({r}) >= 0.9 THEN 'very_strong' "
            f"WHEN abs({r}) >= 0.7 THEN 'strong' WHEN abs({r}) >= 0.5 THEN 'moderate' ELSE 'weak' END AS strength")


@query(union([f"SELECT '{a}' AS column_1, '{b}' AS column_2, round(r, 6) AS correlation, {label_sql('r')} FROM (SELECT corr({a}, {b}) AS r FROM lineitem)" for a, b in PAIRS]))
def pearson_correlation(spark, folder):
    rows = correlation.labelled(correlation.pearson(table(spark, folder, "lineitem"), LINE_NUMBERS))
    return rows.withColumn("correlation", F.round("correlation", 6))


@query("SELECT 'p_partkey' AS column_1, 'p_retailprice' AS column_2, round(r, 6) AS correlation, " + label_sql("r") +
       " FROM (SELECT corr(p_partkey, p_retailprice) AS r FROM part) WHERE abs(r) >= 0.1")
def strong_correlations(spark, folder):
    rows = correlation.labelled(correlation.pearson(table(spark, folder, "part"), ["p_partkey", "p_size", "p_retailprice"]), 0.1)
    return rows.withColumn("correlation", F.round("correlation", 6))


def spearman_sql(a: str, b: str, source: str) -> str:
    def ranks(c: str) -> str:
        return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"

    return (f"SELECT '{a}' AS column_1, '{b}' AS column_2, round(corr(ra, rb), 6) AS correlation FROM (SELECT CAST({ranks(a)} AS DOUBLE) AS ra, "
            f"CAST({ranks(b)} AS DOUBLE) AS rb FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


@query(union([spearman_sql(a, b, "lineitem") for a, b in PAIRS]))
def spearman_correlation(spark, folder):
    return correlation.spearman(table(spark, folder, "lineitem"), LINE_NUMBERS).withColumn("correlation", F.round("correlation", 6))


@query(over(CUSTOMERS_SQL, union([spearman_sql("age", "amount", "t"), spearman_sql("taux_completion", "age", "t").replace("'taux_completion' AS column_1, 'age' AS column_2", "'age' AS column_1, 'taux_completion' AS column_2"),
                                  spearman_sql("taux_completion", "amount", "t")])))
def spearman_with_nulls(spark, folder):
    return correlation.spearman(customers(spark, folder), ["age", "taux_completion", "amount"]).withColumn("correlation", F.round("correlation", 6))


KENDALL_SQL = """WITH p AS (SELECT {x} AS x, {y} AS y, count(*) AS n FROM {t} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1, 2),
  s AS (SELECT sum(CASE WHEN (a.x < b.x AND a.y < b.y) THEN a.n * b.n ELSE 0 END) AS con, sum(CASE WHEN (a.x < b.x AND a.y > b.y) THEN a.n * b.n ELSE 0 END) AS dis FROM p a, p b WHERE a.x < b.x),
  n AS (SELECT sum(n) AS n FROM p), tx AS (SELECT sum(m * (m - 1) / 2) AS v FROM (SELECT sum(n) AS m FROM p GROUP BY x)), ty AS (SELECT sum(m * (m - 1) / 2) AS v FROM (SELECT sum(n) AS m FROM p GROUP BY y))
  SELECT '{x}' AS column_1, '{y}' AS column_2, round((con - dis) / (sqrt(CAST(n.n * (n.n - 1) / 2 - tx.v AS DOUBLE)) * sqrt(CAST(n.n * (n.n - 1) / 2 - ty.v AS DOUBLE))), 6) AS correlation FROM s, n, tx, ty"""


@query(KENDALL_SQL.format(x="p_size", y="p_retailprice", t="part"))
def kendall_correlation(spark, folder):
    return correlation.kendall(table(spark, folder, "part"), "p_size", "p_retailprice").withColumn("correlation", F.round("correlation", 6))


def shape_sql(c: str, t: str) -> str:
    return f"""SELECT '{c}' AS "column", count, round(skewness, 5) AS skewness, round(kurtosis, 5) AS kurtosis, round(k2, 2) AS normality_statistic, round(exp(-k2 / 2), 5) AS normality_pvalue,
      CASE WHEN exp(-k2 / 2) > 0.05 THEN 'approximately_normal' WHEN skewness > 1 THEN 'right_skewed' WHEN skewness < -1 THEN 'left_skewed'
        WHEN kurtosis > 1 THEN 'heavy_tailed' WHEN kurtosis < -1 THEN 'light_tailed' ELSE 'non_normal' END AS distribution_type
    FROM (SELECT *, zs * zs + zk * zk AS k2 FROM (SELECT *, delta * ln(y / alpha + sqrt(y * y / (alpha * alpha) + 1)) AS zs,
        (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS zk
      FROM (SELECT *, 1 / sqrt(0.5 * ln(w2)) AS delta, sqrt(2 / (w2 - 1)) AS alpha, 6 + 8 / b1 * (2 / b1 + sqrt(1 + 4 / (b1 * b1))) AS a
      FROM (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2
      FROM (SELECT *, CAST(n AS BIGINT) AS count, skewness * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
        3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2,
        (kurtosis + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
        6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b1
      FROM (SELECT CAST(count({c}) AS DOUBLE) AS n, avg(power({c} - m, 3)) / power(s, 3) AS skewness, avg(power({c} - m, 4)) / power(s, 4) - 3 AS kurtosis
        FROM {t}, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM {t}) GROUP BY m, s))))))"""


@query(union([shape_sql("value", "events"), shape_sql("user_id", "events")]))
def distribution_shape(spark, folder):
    rows = P.shape(table(spark, folder, "events"), ["value", "user_id"])
    return rows.select("column", "count", *[F.round(x, d).alias(x) for x, d in [("skewness", 5), ("kurtosis", 5), ("normality_statistic", 2), ("normality_pvalue", 5)]], "distribution_type")


@query("""WITH e AS (SELECT min(value) AS low, max(value) AS high FROM events),
  c AS (SELECT least(19, CAST(floor((value - low) / ((high - low) / 20)) AS INT)) AS bin, count(*) AS n FROM events, e WHERE value IS NOT NULL GROUP BY 1)
  SELECT 'value' AS "column", CAST(b.bin AS INT) AS bin, round(low + b.bin * ((high - low) / 20), 6) AS bin_start, round(low + (b.bin + 1) * ((high - low) / 20), 6) AS bin_end, coalesce(n, 0) AS count
  FROM (SELECT unnest(range(20)) AS bin) b JOIN e ON true LEFT JOIN c ON c.bin = b.bin""")
def histogram(spark, folder):
    rows = P.histogram(table(spark, folder, "events"), "value")
    return rows.withColumn("bin_start", F.round("bin_start", 6)).withColumn("bin_end", F.round("bin_end", 6))


@query()
def content_hash(spark, folder):
    return P.content_hash(table(spark, folder, "lineitem"))


# Business types. The words found in the names of these columns:
NAME_TYPES = {"full_name": "full_name", "email": "email", "phone": "phone", "code_postal": "postal_code", "age": "age", "taux_completion": "percentage",
              "amount": "monetary_amount", "is_active": "boolean_text"}


def semantic_sql(c: str) -> str:
    text = c in CUSTOMER_TEXT
    rules = [f"WHEN count({c}) = 0 THEN ['free_text', '0.5']"]
    if text:
        for f, kind in [("email", "email"), ("phone", "phone"), ("url", "url"), ("postal", "postal_code"), ("ip", "ip_address")]:
            rules.append(f"WHEN count(*) FILTER (WHERE {fmt(stripped(c), f)}) >= 0.7 * count({c}) THEN ['{kind}', '0.65']")
        rules.append(f"WHEN count(*) FILTER (WHERE {is_date(c)}) >= 0.7 * count({c}) THEN ['date_string', '0.65']")
        rules.append(f"WHEN count(*) FILTER (WHERE lower({stripped(c)}) IN {in_list(K.BOOLEAN_TOKENS)}) >= 0.8 * count({c}) THEN ['boolean_text', '0.65']")
    word = NAME_TYPES.get(c)
    if word in K.SEMANTIC_RANGES:
        lo, hi = K.SEMANTIC_RANGES[word]
        rules.append(f"WHEN count(*) FILTER (WHERE {c} BETWEEN {lo} AND {hi}) >= 0.9 * count({c}) THEN ['{word}', '0.75']")
    if word:
        rules.append(f"WHEN true THEN ['{word}', '0.62']")
    unique = f"(count(*) >= 5 AND count(DISTINCT {c}) = count(*))"
    if c.endswith("_id"):
        rules.append(f"WHEN {unique} THEN ['identifier', '0.7'] WHEN true THEN ['identifier', '0.63']")
    rules.append(f"WHEN {unique} THEN ['identifier', '0.63']")
    if text:
        rules.append(f"WHEN count({c}) >= 5 AND count(DISTINCT {c}) BETWEEN 2 AND 10 AND count(DISTINCT {c}) <= 0.4 * count({c}) THEN ['category', '0.6']")
        rules.append(f"WHEN avg(length({c})) > 50 THEN ['description', '0.55']")
    return f"SELECT '{c}' AS \"column\", CASE {' '.join(rules)} ELSE ['free_text', '0.5'] END AS a FROM t"


SEMANTIC_TYPES_SQL = over(CUSTOMERS_SQL, "SELECT \"column\", a[1] AS semantic_type, CAST(a[2] AS DOUBLE) AS confidence FROM (" + union([semantic_sql(c) for c in CUSTOMERS]) + ")")


@query(SEMANTIC_TYPES_SQL)
def semantic_types(spark, folder):
    return semantic.semantic_types(customers(spark, folder)).select("column", "semantic_type", "confidence")


GIVEN = [("code", "product_code", 0.9), ("age", "quantity", 0.7), ("brand_new", "city", 0.4)]


@query(f"""WITH h AS ({SEMANTIC_TYPES_SQL}), g AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', CAST({x} AS DOUBLE))" for a, b, x in GIVEN)}) v("column", semantic_type, confidence))
  SELECT coalesce(h."column", g."column") AS "column", CASE WHEN h."column" IS NULL OR g.confidence > h.confidence THEN g.semantic_type ELSE h.semantic_type END AS semantic_type,
  CASE WHEN h."column" IS NULL OR g.confidence > h.confidence THEN g.confidence ELSE h.confidence END AS confidence,
  CASE WHEN h."column" IS NULL OR g.confidence > h.confidence THEN 'given' ELSE 'heuristic' END AS method FROM h FULL OUTER JOIN g ON h."column" = g."column" """)
def merged_semantic_types(spark, folder):
    given = spark.createDataFrame(GIVEN, "column string, semantic_type string, confidence double")
    return semantic.merge(semantic.semantic_types(customers(spark, folder)), given)


@query(f"""WITH h AS ({SEMANTIC_TYPES_SQL}), c AS ({over(CUSTOMERS_SQL, counts_sql(list(CUSTOMERS)))})
  SELECT c."column", semantic_type, confidence, null_percentage, unique_count, round(100.0 * (SELECT count(*) FROM h WHERE semantic_type <> 'free_text') / (SELECT count(*) FROM c), 1) AS semantic_coverage
  FROM c LEFT JOIN (SELECT * FROM h WHERE semantic_type <> 'free_text') h ON c."column" = h."column" """)
def schema_export(spark, folder):
    df = customers(spark, folder)
    rows = semantic.schema_export(P.profile(df), semantic.semantic_types(df).where("semantic_type <> 'free_text'"))
    return rows.select("column", "semantic_type", "confidence", "null_percentage", "unique_count", "semantic_coverage")


@query(over("SELECT event_type, value FROM events", counts_sql(["event_type", "value"])))
def column_subset(spark, folder):
    return P.column_counts(table(spark, folder, "events"), ["event_type", "value"])
