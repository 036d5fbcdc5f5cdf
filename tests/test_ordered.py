"""The sliced scan equals plain windows, also when one key holds most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from kerbline.operators.ordered import number_rows, scan


def rows(spark, n=400, hot=0.6):
    rng = random.Random(5)
    data = [(i, "hot" if rng.random() < hot else f"k{rng.randrange(8)}", rng.randrange(60), rng.choice([None, 1, 2, 7])) for i in range(n)]
    return spark.createDataFrame(data, "id bigint, k string, t int, v int")


def test_scan_equals_window(spark):
    df = rows(spark)
    got = scan(
        df, ["t", "id"], ["k"], sums={"s": "v", "n": F.lit(1).cast("long")}, last_known={"l": "v"}, next_known={"x": "v"}, previous={"p": "v"}, following={"f": "v"}, slices=7
    )
    w = Window.partitionBy("k").orderBy("t", "id")
    up, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = df.select(
        "*",
        F.coalesce(F.sum("v").over(up), F.lit(0)).alias("s"), F.row_number().over(w).cast("long").alias("n"),
        F.last("v", True).over(up).alias("l"), F.first("v", True).over(on).alias("x"), F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("f"),
    )
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_scan_without_keys_and_with_ties(spark):
    df = rows(spark).withColumn("t", F.lit(1))
    got = number_rows(df, ["t", "id"], slices=5).select("id", "row_no").collect()
    assert sorted(r["row_no"] for r in got) == list(range(1, 401))
    assert all(r["row_no"] == r["id"] + 1 for r in got)


def test_scan_has_no_single_partition_window(spark):
    plan = number_rows(rows(spark), ["t", "id"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "row_no" in line]
    assert all("__slice" in line for line in windows)
