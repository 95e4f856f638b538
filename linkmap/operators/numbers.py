"""Consecutive numbers in an order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkmap.operators.components import cut_lineage

_LOW = (1 << 33) - 1
#: Rows that running_sums takes together.
STRETCH = 1 << 16


def row_numbers(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with a column of numbers from 0 on in the given order, which should leave no ties.

    Rows are range-partitioned and sorted; a number is the row's place in its
    partition and the count of the partitions before, one row for each.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = cut_lineage(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__place", 33)
    counts = {r["p"]: r["n"] for r in place.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for p in sorted(counts):
        before.append((p, total))
        total += counts[p]
    offsets = df.sparkSession.createDataFrame(before or [(0, 0)], "__part long, __before long")
    met = place.withColumn("__part", part.cast("long")).join(F.broadcast(offsets), "__part")
    return met.withColumn(name, F.col("__before") + F.col("__place").bitwiseAND(F.lit(_LOW))).drop("__part", "__before", "__place")


def running_sums(df: DataFrame, order: list[str | Column], value: str, name: str) -> DataFrame:
    """df with the sum of a column up to and with each row in the given order, which should leave no ties; numbered stretches of rows are summed one by one."""
    rows = row_numbers(df, order, "__n").withColumn("__s", F.floor(F.col("__n") / STRETCH))
    from pyspark.sql import Window as W

    inner = F.sum(value).over(W.partitionBy("__s").orderBy("__n").rowsBetween(W.unboundedPreceding, 0))
    sums = rows.groupBy("__s").agg(F.sum(value).alias("__t"))
    before = sums.withColumn("__before", F.sum("__t").over(W.orderBy("__s").rowsBetween(W.unboundedPreceding, -1))).select("__s", "__before")  # one row for each stretch
    return rows.withColumn("__inner", inner).join(before, "__s").withColumn(name, F.col("__inner") + F.coalesce("__before", F.lit(0))).drop("__n", "__s", "__inner", "__before")
