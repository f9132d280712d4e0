"""Ranks and numbers over a whole table without one task holding it.

Distinct values are counted first and cut into ranges; only the number of rows in each range goes to the driver (one number a partition),
and each range then continues from the sum of those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argosift.runtime import cut


def _offsets(df: DataFrame, order: list, count: str) -> DataFrame:
    """The table cut into ranges by ``order``, with the column ``_before``: the sum of ``count`` up to and without each row."""
    spark = df.sparkSession
    parts = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = sorted(parts.groupBy("_p").agg(F.sum(count).alias("n")).collect())  # one row a partition
    total, starts = 0, []
    for p, n in sizes:
        starts.append((p, total))
        total += n
    first = spark.createDataFrame(starts, "_p int, _start bigint")
    w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.join(F.broadcast(first), "_p").withColumn("_before", F.sum(count).over(w) + F.col("_start") - F.col(count))
    return summed.drop("_p", "_start")


def average_ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """All rows with a non-null value and their rank from 1; equal values share the mean of their ranks."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranks = _offsets(counts, ["_v"], "_n").select("_v", (F.col("_before") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, df[value] == ranks["_v"]).drop("_v")


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """All rows numbered from 0 in order; ``order`` must be a unique key, else equal keys are numbered in any order."""
    return _offsets(df.withColumn("_one", F.lit(1)), order, "_one").withColumn(name, F.col("_before").cast("bigint")).drop("_one", "_before")
