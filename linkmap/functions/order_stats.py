"""Exact order statistics from histograms: what is collected or broadcast is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nth_values(df: DataFrame, column: str, ranks: dict[str, Column]) -> DataFrame:
    """One row with, for each name, the value at a 0-based rank of the sorted column; ranks are expressions of column n, the count.

    The histogram combines before it shuffles, so the window over it has a
    row for each distinct value and not for each row.
    """
    hist = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    upto = hist.withColumn("upto", F.sum("c").over(W.orderBy("x").rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(W.partitionBy()))
    return upto.agg(*[F.min(F.when(F.col("upto") > rank, F.col("x"))).alias(name) for name, rank in ranks.items()])


def median_low(x: Column) -> Column:
    """The value at rank (n - 1) div 2 of an aggregate's group."""
    return F.element_at(F.array_sort(F.collect_list(x)), (F.floor((F.count(x) - 1) / 2) + 1).cast("int"))


def nearest_rank(sorted_values: Column, p: float) -> Column:
    """The value at rank round(p (n - 1)) of a sorted array, halves away from zero."""
    return F.element_at(sorted_values, (F.floor(F.lit(p) * (F.size(sorted_values) - 1) + 0.5) + 1).cast("int"))
