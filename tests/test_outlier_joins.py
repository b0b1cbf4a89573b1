"""Rows of one value are looked up in parts."""

from pyspark.sql import functions as F

from plumbline.operators import outliers


def test_investigating_a_hot_value(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    rows = outliers.investigate(df, "v", ["id"], F.lit(True)).select("id", "value", "below").collect()
    values = sorted(7.0 if i % 2 == 0 else float(i) for i in range(4000))
    first = {}
    for at, v in enumerate(values):
        first.setdefault(v, at)
    assert len(rows) == 4000 and all(r["below"] == first[r["value"]] for r in rows)
    assert len({r["id"] for r in rows}) == 4000
