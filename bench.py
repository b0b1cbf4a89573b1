"""Times the headline queries and prints one JSON line. Each figure is the better of two runs."""

from __future__ import annotations

import json
import os
import time

from plumbline import catalog
from plumbline.operators import corrections as R
from plumbline.operators import outliers as O
from plumbline.operators import profile as prof
from plumbline.plans import analysis
from plumbline.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def headline(spark):
    from plumbline.catalog.fixtures import customers, drift_sides, table
    from plumbline.operators import drift as D

    lineitem = table(spark, FOLDER, "lineitem")
    dirty = customers(spark, FOLDER)
    numbers = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

    def forest():
        fitted = O.fit_forest(lineitem, LINE_KEY, numbers)
        return O.detect_outliers(lineitem, fitted, LINE_KEY)

    def apply_and_compare():
        plan = R.CorrectionPlan(drop_duplicates=True, unmask=["email", "segment"], trim=["email"], impute={"age": "median", "email": "mode", "segment": "mode"})
        return analysis.correct_and_compare(dirty, plan, checks=["missing_values", "pseudo_nulls", "format"])[1]["scores"]

    return {
        "fused_profile_lineitem": lambda: prof.profile(lineitem),
        "issue_report_customers": lambda: analysis.find_issues(dirty),
        "issue_report_lineitem": lambda: analysis.find_issues(lineitem),
        "drift_events": lambda: D.detect_drift(*drift_sides(spark, FOLDER)),
        "isolation_forest_lineitem": forest,
        "apply_and_compare_customers": apply_and_compare,
    } | {name: (lambda fn=catalog.QUERIES[name]: fn(spark, FOLDER)) for name in [
        "numeric_summary", "duplicate_rows", "duplicate_documents", "pearson_correlation", "spearman_correlation", "kendall_correlation",
        "near_duplicate_rows", "nearest_vectors", "matched_rules", "validated_corrections", "score_trends", "confidence_fold", "technical_types_of_documents",
    ]}


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=max(8, int(CPUS)))
    spark.sparkContext.setLogLevel("OFF")
    catalog.load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name, build in headline(spark).items():
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline queries, better of two runs", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
