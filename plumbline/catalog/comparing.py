"""Queries on drift between tables and on outliers within them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.catalog.fixtures import DRIFTING, DRIFTING_SQL, EARLY, LATE, as_sql, derive, drift_sides, table
from plumbline.operators import baselines as B
from plumbline.operators import drift as D
from plumbline.operators import outliers as O

c = F.col
R = f"SELECT * FROM ({DRIFTING_SQL}) WHERE {EARLY}"
Q = f"SELECT * FROM ({DRIFTING_SQL}) WHERE {LATE}"


def over_sides(body: str) -> str:
    return f"WITH r AS ({R}), q AS ({Q}) {body}"


def ks_sql(x: str) -> str:
    return f"""SELECT '{x}' AS "column", max(abs(fr - fq)) AS statistic, max(nr) AS total_ref, max(nq) AS total_cur FROM (
      SELECT v, sum(r) OVER (ORDER BY v) / CAST(sum(r) OVER () AS DOUBLE) AS fr, sum(q) OVER (ORDER BY v) / CAST(sum(q) OVER () AS DOUBLE) AS fq, CAST(sum(r) OVER () AS BIGINT) AS nr, CAST(sum(q) OVER () AS BIGINT) AS nq
      FROM (SELECT v, sum(a) AS r, sum(b) AS q FROM (SELECT {x} AS v, 1 AS a, 0 AS b FROM r UNION ALL SELECT {x}, 0, 1 FROM q) WHERE v IS NOT NULL GROUP BY v))"""


SERIES = "2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * z)))"


@query(over_sides(f"""SELECT "column", round(statistic, 6) AS statistic, round(CASE WHEN z < 0.04 THEN 1.0 ELSE greatest(0.0, least(1.0, {SERIES})) END, 6) AS p_value, total_ref, total_cur
  FROM (SELECT *, statistic * statistic * total_ref * total_cur / (total_ref + total_cur) AS z FROM ({ks_sql('value')} UNION ALL {ks_sql('steady')}))"""))
def kolmogorov_smirnov(spark, folder):
    ref, cur = drift_sides(spark, folder)
    rows = D.kolmogorov_smirnov(D.paired_frequencies(ref, cur, ["value", "steady"]))
    return rows.select("column", F.round("statistic", 6).alias("statistic"), F.round("p_value", 6).alias("p_value"), "total_ref", "total_cur")


def edges_sql(x: str) -> str:
    return f"(SELECT list_sort(list_distinct(quantile_cont(CAST({x} AS DOUBLE), [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) FROM r)"


def bins_sql(x: str) -> str:
    def side(t: str) -> str:
        return f"(SELECT greatest(1, len(list_filter(e, lambda b: b < {x}))) AS bin, count(*) AS n FROM {t}, (SELECT {edges_sql(x)} AS e) WHERE {x} BETWEEN e[1] AND e[-1] GROUP BY 1)"

    return (f"SELECT b.bin, coalesce(br.n, 0) AS nr, coalesce(bq.n, 0) AS nq FROM (SELECT unnest(range(1, len({edges_sql(x)}))) AS bin) b LEFT JOIN {side('r')} br ON br.bin = b.bin LEFT JOIN {side('q')} bq ON bq.bin = b.bin")


def psi_sql(x: str) -> str:
    return f"""SELECT '{x}' AS "column", round(sum((pq - pr) * ln(pq / pr)), 6) AS psi FROM (SELECT nr / CAST((SELECT count({x}) FROM r) AS DOUBLE) + 1e-10 AS pr, nq / CAST((SELECT count({x}) FROM q) AS DOUBLE) + 1e-10 AS pq FROM ({bins_sql(x)}))"""


@query(over_sides(psi_sql("value") + " UNION ALL " + psi_sql("steady")))
def population_stability(spark, folder):
    ref, cur = drift_sides(spark, folder)
    return D.population_stability(D.paired_frequencies(ref, cur, ["value", "steady"])).withColumn("psi", F.round("psi", 6))


@query(over_sides(psi_sql("value") + " UNION ALL " + psi_sql("steady")))
def drift_against_baseline(spark, folder):
    ref, cur = drift_sides(spark, folder)
    stored = D.baseline(ref, ["value", "steady"])["bins"]
    return D.psi_against_baseline(cur, stored).withColumn("psi", F.round("psi", 6))


SHARES_SQL = """SELECT 'kind' AS "column", kind AS category, coalesce(r.n, 0) AS n_ref, coalesce(q.n, 0) AS n_cur FROM (SELECT kind, count(*) AS n FROM r GROUP BY kind) r FULL OUTER JOIN (SELECT kind, count(*) AS n FROM q GROUP BY kind) q USING (kind)"""
TOTAL = "(SELECT count(*) FROM {t})"


CHI_SQL = f"""SELECT 'kind' AS "column", round(sum(power(n_ref - er, 2) / er + power(n_cur - eq, 2) / eq), 5) AS statistic, CAST(count(*) - 1 AS DOUBLE) AS freedom FROM (
  SELECT n_ref, n_cur, (n_ref + n_cur) * CAST({TOTAL.format(t='r')} AS DOUBLE) / ({TOTAL.format(t='r')} + {TOTAL.format(t='q')}) AS er, (n_ref + n_cur) * CAST({TOTAL.format(t='q')} AS DOUBLE) / ({TOTAL.format(t='r')} + {TOTAL.format(t='q')}) AS eq FROM ({SHARES_SQL}))"""


@query(over_sides(CHI_SQL))
def chi_squared(spark, folder):
    ref, cur = drift_sides(spark, folder)
    rows = D.chi_squared(D.paired_frequencies(ref, cur, ["kind"]))
    return rows.select("column", F.round("statistic", 5).alias("statistic"), "freedom")


@query(over_sides(f"""SELECT "column", total_ref, total_cur, NULL AS statistic, true AS near_exact FROM ({ks_sql('value')} UNION ALL {ks_sql('steady')})
  UNION ALL SELECT "column", (SELECT count(kind) FROM r), (SELECT count(kind) FROM q), statistic, true FROM ({CHI_SQL})"""))
def baseline_compared(spark, folder):
    """The later events against a baseline of the earlier ones, kept day by day and merged: KS within the bound of the sketches, chi-squared exact."""
    ref, cur = drift_sides(spark, folder)
    days = derive(table(spark, folder, "events"), DRIFTING).where(F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"))
    stored = B.merged(B.summarise(days, ["value", "steady", "kind"], F.to_date("ts")))
    found = B.drift_against(stored, cur)
    exact = D.kolmogorov_smirnov(D.paired_frequencies(ref, cur, ["value", "steady"])).select("column", c("statistic").alias("exact"))
    both = found.join(exact, "column", "left")
    near = F.coalesce(F.abs(c("statistic") - c("exact")) <= B.rank_error(), F.lit(True))
    return both.select("column", "total_ref", "total_cur", F.when(c("column") == "kind", F.round("statistic", 5)).alias("statistic"), near.alias("near_exact"))


@query(over_sides(f"""SELECT 'kind' AS "column", round((sum(power(pq - pr, 2) / pr)) / 1e6, 3) AS millions FROM (SELECT (n_ref + 1e-10) / ({TOTAL.format(t='r')} + k * 1e-10) AS pr, (n_cur + 1e-10) / ({TOTAL.format(t='q')} + k * 1e-10) AS pq
  FROM ({SHARES_SQL}), (SELECT count(*) AS k FROM ({SHARES_SQL})))"""))
def chi_squared_on_shares(spark, folder):
    """The statistic on shares: a category the reference lacks outweighs everything else."""
    ref, cur = drift_sides(spark, folder)
    rows = D.chi_squared(D.paired_frequencies(ref, cur, ["kind"]), on_shares=True)
    return rows.select("column", F.round(c("statistic") / 1e6, 3).alias("millions"))


@query(over_sides(f"SELECT *, round(n_ref / CAST({TOTAL.format(t='r')} AS DOUBLE), 6) AS reference, round(n_cur / CAST({TOTAL.format(t='q')} AS DOUBLE), 6) AS current FROM ({SHARES_SQL})"))
def category_shares(spark, folder):
    ref, cur = drift_sides(spark, folder)
    rows = D.category_shares(D.paired_frequencies(ref, cur, ["kind"]))
    return rows.select("column", "category", "n_ref", "n_cur", F.round("reference", 6).alias("reference"), F.round("current", 6).alias("current"))


@query(over_sides(f"""SELECT category, round(change, 6) AS change, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (ORDER BY round(abs(change), 12) DESC, category) AS place FROM (
  SELECT category, n_cur / CAST({TOTAL.format(t='q')} AS DOUBLE) - n_ref / CAST({TOTAL.format(t='r')} AS DOUBLE) AS change FROM ({SHARES_SQL})) WHERE abs(change) > 0.01) WHERE place <= 10"""))
def largest_share_changes(spark, folder):
    ref, cur = drift_sides(spark, folder)
    return D.category_changes(D.category_shares(D.paired_frequencies(ref, cur, ["kind"]))).select("category", F.round("change", 6).alias("change"), "place")


@query(over_sides("""SELECT * FROM (SELECT 'reference' AS side, kind AS category, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, kind) AS INT) AS place FROM r GROUP BY kind) WHERE place <= 5
  UNION ALL SELECT * FROM (SELECT 'current', kind, count(*), CAST(row_number() OVER (ORDER BY count(*) DESC, kind) AS INT) AS place FROM q GROUP BY kind) WHERE place <= 5"""))
def top_categories_by_side(spark, folder):
    ref, cur = drift_sides(spark, folder)
    return D.category_top(D.category_shares(D.paired_frequencies(ref, cur, ["kind"]))).select("side", "category", "n", "place")


@query(over_sides("""SELECT 'kind' AS "column", kind AS category, 'new' AS status FROM (SELECT DISTINCT kind FROM q) WHERE kind NOT IN (SELECT kind FROM r)
  UNION ALL SELECT 'kind', kind, 'removed' FROM (SELECT DISTINCT kind FROM r) WHERE kind NOT IN (SELECT kind FROM q)"""))
def new_and_removed_categories(spark, folder):
    ref, cur = drift_sides(spark, folder)
    return D.new_and_removed(ref, cur, ["kind"])


@query(over_sides("""SELECT 'value' AS "column", round(100 * ((SELECT avg(value) FROM q) - (SELECT avg(value) FROM r)) / (SELECT avg(value) FROM r), 5) AS mean_change_percent,
  round(100 * ((SELECT stddev_samp(value) FROM q) - (SELECT stddev_samp(value) FROM r)) / (SELECT stddev_samp(value) FROM r), 5) AS std_change_percent"""))
def mean_and_deviation_changes(spark, folder):
    ref, cur = drift_sides(spark, folder)
    rows = D.numeric_changes(ref, cur, ["value"])
    return rows.select("column", *[F.round(x, 5).alias(x) for x in ("mean_change_percent", "std_change_percent")])


@query(over_sides(" UNION ALL ".join(
    f"SELECT CAST({p} AS DOUBLE) AS prob, round(a, 6) AS reference, round(b, 6) AS current, round(b - a, 6) AS change FROM (SELECT quantile_cont(value, {p}) AS a FROM r), (SELECT quantile_cont(value, {p}) AS b FROM q)" for p in (0.1, 0.25, 0.5, 0.75, 0.9))))
def quantile_changes(spark, folder):
    ref, cur = drift_sides(spark, folder)
    rows = D.quantile_changes(D.paired_frequencies(ref, cur, ["value"]))
    return rows.select("prob", *[F.round(x, 6).alias(x) for x in ("reference", "current", "change")])


LEVEL = "CASE WHEN p >= 0.05 AND psi < 0.1 THEN 'none' WHEN psi < 0.1 THEN 'low' WHEN psi < 0.25 THEN 'medium' WHEN psi < 0.5 THEN 'high' ELSE 'critical' END"
NUMERIC_DRIFT_SQL = f"""SELECT "column", {LEVEL} AS severity, round(least(1.0, psi / 0.5), 5) AS drift_score FROM (SELECT k."column", s.psi, CASE WHEN z < 0.04 THEN 1.0 ELSE {SERIES} END AS p
  FROM (SELECT *, statistic * statistic * total_ref * total_cur / (total_ref + total_cur) AS z FROM ({ks_sql('value')} UNION ALL {ks_sql('steady')})) k JOIN ({psi_sql('value')} UNION ALL {psi_sql('steady')}) s USING ("column"))"""


@query(over_sides(NUMERIC_DRIFT_SQL))
def numeric_drift(spark, folder):
    ref, cur = drift_sides(spark, folder)
    rows = D.detect_drift(ref, cur, ["value", "steady"])
    return rows.select("column", "severity", F.round("drift_score", 5).alias("drift_score"))


@query()
def drift_report(spark, folder):
    """Every shared column, numeric and categorical."""
    return D.detect_drift(*drift_sides(spark, folder))


@query(over_sides(f"""SELECT count(*) AS total_columns, count(*) FILTER (WHERE severity <> 'none') AS columns_with_drift, round(100.0 * count(*) FILTER (WHERE severity <> 'none') / count(*), 1) AS drift_percentage,
  max_by("column", drift_score) AS most_drifted_column, max(drift_score) AS max_drift_score FROM ({NUMERIC_DRIFT_SQL})"""))
def drift_summary(spark, folder):
    ref, cur = drift_sides(spark, folder)
    rows = D.drift_summary(D.detect_drift(ref, cur, ["value", "steady"]))
    return rows.select("total_columns", "columns_with_drift", "drift_percentage", "most_drifted_column", F.round("max_drift_score", 5).alias("max_drift_score"))


@query()
def drift_issues(spark, folder):
    ref, cur = drift_sides(spark, folder)
    found = D.drift_issues(D.detect_drift(ref, cur), cur.agg(F.count(F.lit(1)).alias("n")).scalar())
    return found.select("rule_id", "issue_type", "severity", "column", "affected_count", "affected_percentage", "confidence")


# Outliers

WILD = {"event_id": "event_id", "value": "CASE WHEN event_id % 101 = 0 THEN 5000 + event_id % 7 WHEN event_id % 103 = 0 THEN NULL ELSE value END", "user_id": "user_id"}
WILD_SQL = "SELECT event_id, CASE WHEN event_id % 101 = 0 THEN 5000 + event_id % 7 WHEN event_id % 103 = 0 THEN NULL ELSE value END AS value, user_id FROM events"


def wild(spark, folder):
    """Events with a few values far out and a few missing."""
    return derive(table(spark, folder, "events"), WILD)


@query()
def isolation_forest(spark, folder):
    df = wild(spark, folder)
    return O.detect_outliers(df, O.fit_forest(df, ["event_id"], ["value", "user_id"]), ["event_id"])


@query()
def outlier_columns(spark, folder):
    df = table(spark, folder, "lineitem")
    return O.outlier_columns(df, O.fit_forest(df, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query()
def outlier_summary(spark, folder):
    df = wild(spark, folder)
    return O.outlier_summary(O.outlier_columns(df, O.fit_forest(df, ["event_id"], ["value", "user_id"])))


@query()
def outlier_issues(spark, folder):
    df = wild(spark, folder)
    found = O.outlier_issues(O.outlier_columns(df, O.fit_forest(df, ["event_id"], ["value"])))
    return found.select("rule_id", "issue_type", "severity", "column", "affected_count", "affected_percentage")


def context_sql(x: str) -> str:
    return f"SELECT '{x}' AS \"column\", round(avg({x}), 5) AS mean, round(stddev_samp({x}), 5) AS std, round(quantile_cont(CAST({x} AS DOUBLE), 0.01), 5) AS p1, round(quantile_cont(CAST({x} AS DOUBLE), 0.99), 5) AS p99 FROM t"


@query(f"WITH t AS ({WILD_SQL}) {context_sql('value')} UNION ALL {context_sql('user_id')}")
def outlier_context(spark, folder):
    rows = O.column_context(wild(spark, folder), ["value", "user_id"])
    return rows.select("column", *[F.round(x, 5).alias(x) for x in ("mean", "std", "p1", "p99")])


INVESTIGATE_SQL = f"""WITH t AS ({WILD_SQL}), s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM t),
  b AS (SELECT event_id, value, (rank() OVER (ORDER BY value)) - 1 AS below FROM t WHERE value IS NOT NULL),
  x AS (SELECT event_id, value, below, (value - m) / sd AS z, 100.0 * below / n AS pct, value < q1 - 1.5 * (q3 - q1) AS lo, value > q3 + 1.5 * (q3 - q1) AS hi FROM b, s WHERE value > 200)"""


@query(f"""{INVESTIGATE_SQL} SELECT event_id, value, round(z, 5) AS z_score, round(pct, 5) AS percentile, lo OR hi AS is_outlier_iqr,
  concat_ws(',', CASE WHEN abs(z) > 3 THEN 'z_score' END, CASE WHEN lo THEN 'below_iqr_fence' END, CASE WHEN hi THEN 'above_iqr_fence' END, CASE WHEN pct < 1 THEN 'first_percentile' END, CASE WHEN pct > 99 THEN 'last_percentile' END) AS reasons FROM x""")
def investigated_values(spark, folder):
    rows = O.investigate(wild(spark, folder), "value", ["event_id"], c("value") > 200)
    return rows.select("event_id", "value", F.round("z_score", 5).alias("z_score"), F.round("percentile", 5).alias("percentile"), "is_outlier_iqr", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH t AS ({WILD_SQL}), b AS (SELECT value, (rank() OVER (ORDER BY value)) - 1 AS below, (row_number() OVER (ORDER BY value)) - 1 AS place FROM t WHERE value IS NOT NULL),
  a AS (SELECT DISTINCT below FROM b WHERE value > 200), o AS (SELECT unnest(range(-2, 3)) AS off)
  SELECT a.below, CAST(o.off AS INT) AS "offset", b.value AS nearby FROM a, o JOIN b ON b.place = a.below + o.off""")
def values_near_outliers(spark, folder):
    df = wild(spark, folder)
    return O.nearest_values(df, "value", O.investigate(df, "value", ["event_id"], c("value") > 200))


PLANTED = {"o_orderkey": "o_orderkey", "price": "CASE WHEN o_orderkey % 500 = 0 THEN 1000000000.0 + o_totalprice ELSE o_totalprice END"}


@query(f"""SELECT 'price' AS "column", count(*) FILTER (WHERE price > 900000000) AS planted, count(*) FILTER (WHERE price > 900000000) AS planted_found, true AS within_share, true AS same_after_repartition
  FROM ({as_sql(PLANTED, "orders")})""")
def planted_outliers_found(spark, folder):
    """The forest finds every planted price, marks no larger share than asked for, and the same rows however they are partitioned."""
    df = derive(table(spark, folder, "orders"), PLANTED)
    runs = []
    for rows in (df, df.repartition(13)):
        runs.append(O.detect_outliers(rows, O.fit_forest(rows, ["o_orderkey"], ["price"], contamination=0.05), ["o_orderkey"]))
    first, second = (x.groupBy("column").agg(
        F.count(F.lit(1)).alias(f"n{i}"), F.count_if(F.col("value") > 900000000).alias(f"found{i}"), F.bit_xor(F.xxhash64("o_orderkey", "value")).alias(f"rows{i}")) for i, x in enumerate(runs))
    totals = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("price") > 900000000).alias("planted"))
    return first.join(second, "column", "full_outer").select(
        "column", totals.select("planted").scalar().alias("planted"), F.col("found0").alias("planted_found"),
        (F.col("n0") <= 0.05 * totals.select("n").scalar() + 1).alias("within_share"),
        (F.col("n0").eqNullSafe(F.col("n1")) & F.col("rows0").eqNullSafe(F.col("rows1"))).alias("same_after_repartition"),
    )
