"""Blocked computations against plain windows, with one group holding most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirefold.operators import blocks as B


def skewed(spark, rows=3000, seed=1):
    rng = random.Random(seed)
    data, taken = [], set()
    for _ in range(rows):
        group = 0 if rng.random() < 0.7 else rng.randint(1, 40)
        position = rng.randint(0, 5000)
        if (group, position) not in taken:
            taken.add((group, position))
            data.append((group, position, rng.randint(0, 9), rng.choice(["a", "b", None])))
    return spark.createDataFrame(data, "g int, p int, n int, v string")


def same(left, right):
    columns = sorted(left.columns)
    assert sorted(map(tuple, left.select(columns).collect()), key=repr) == sorted(map(tuple, right.select(columns).collect()), key=repr)


def test_running_offset(spark):
    df = skewed(spark)
    window = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    expected = df.withColumn("s", F.coalesce(F.sum("n").over(window), F.lit(0)))
    for size in (7, 100, 10000):
        same(B.running_offset(df, ["g"], "p", F.col("n"), "s", size=size), expected)


def test_negative_positions(spark):
    df = skewed(spark).withColumn("p", F.col("p") - 2500)
    window = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    expected = df.withColumn("s", F.coalesce(F.sum("n").over(window), F.lit(0)))
    for size in (7, 10000):
        same(B.running_offset(df, ["g"], "p", F.col("n"), "s", size=size), expected)


def test_row_index(spark):
    df = skewed(spark)
    expected = df.withColumn("i", (F.row_number().over(Window.partitionBy("g").orderBy("p")) - 1).cast("long"))
    same(B.row_index(df, ["g"], "p", "i", size=13), expected)


def test_last_before(spark):
    df = skewed(spark)
    window = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    expected = df.withColumn("l", F.last("v", ignorenulls=True).over(window))
    for size in (5, 64, 10000):
        same(B.last_before(df, ["g"], "p", F.col("v"), "l", size=size), expected)


def test_top_k(spark):
    df = skewed(spark).withColumn("k", F.col("g") % 5)
    window = Window.partitionBy("g").orderBy("n", "p")
    expected = df.withColumn("rank", F.row_number().over(window)).where((F.col("rank") <= 3) & (F.col("rank") <= F.col("k")))
    same(B.top_k(df, ["g"], [F.col("n"), F.col("p")], 3, ["p"], k=F.col("k"), fan=4), expected)
    assert B.top_k(df, ["g"], [F.col("n")], -1, ["p"]).count() == 0


def test_global_index(spark):
    df = skewed(spark).withColumn("n", F.lit(1))
    order = [F.desc("n"), F.asc("g"), F.asc("p")]
    expected = df.withColumn("i", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1).cast("long"))
    same(B.global_index(df, order, "i"), expected)
