"""One document holds a third of all rows; no task may get much more than its share."""

import re

from pyspark.sql import functions as F

from quirefold.operators import blocks as B

ROWS, PARTITIONS = 600_000, 64


def largest_share(spark, df):
    """Rows of the fullest task over the mean."""
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(PARTITIONS))
    try:
        # The hash keeps the computed column, and so its window, in the plan.
        used = df.select(F.spark_partition_id().alias("task"), F.hash(*df.columns).alias("h"))
        sizes = [r["n"] for r in used.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.max("h")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept[0])
        spark.conf.set("spark.sql.shuffle.partitions", kept[1])
    assert sum(sizes) == ROWS
    return max(sizes) * PARTITIONS / ROWS


def hot(spark):
    third = F.col("id") % 3 == 0
    return spark.range(ROWS).select(
        F.when(third, F.lit(0)).otherwise(F.col("id") % 5000 + 1).alias("g"),
        F.when(third, F.col("id") / 3).otherwise(F.col("id") / 5000).cast("long").alias("p"),
    )


def test_blocked_jobs_are_balanced(spark):
    df = hot(spark)
    assert largest_share(spark, B.row_index(df, ["g"], "p", "i", size=512)) < 3
    assert largest_share(spark, B.last_before(df, ["g"], "p", F.col("p"), "l", size=512)) < 3


def test_rows_dealt_by_the_group_before_are_balanced(spark):
    """A join, a repartition or a bucketed table has dealt the rows by the group alone."""
    df = hot(spark).repartition(PARTITIONS, "g")
    assert largest_share(spark, B.row_index(df, ["g"], "p", "i", size=512)) < 3
    assert largest_share(spark, B.last_before(df, ["g"], "p", F.col("p"), "l", size=512)) < 3


def test_slices_of_top_k_are_dealt_anew(spark):
    df = hot(spark).repartition(PARTITIONS, "g")
    plan = B.top_k(df, ["g"], [F.col("p")], 5, ["p"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(_sign#\d+L, _deal#", plan)


def test_plain_window_is_not(spark):
    """The measure itself: a window by group puts a third of the rows into one task."""
    from pyspark.sql import Window

    plain = hot(spark).withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("p")))
    assert largest_share(spark, plain) > PARTITIONS / 3
