"""The overlap graph: how many minimizers each two groups share.

The inverted index is a self-join on the minimizer; ``u < v`` keeps one half.
A minimizer of df groups gives about
df² / 2 pairs, which is why repetitive ones go before; where they are kept,
the join's hot keys are split by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkmap.operators.filters import set_sizes


def overlap_edges(inc: DataFrame, min_m: int) -> DataFrame:
    """(u, v, m) of all pairs with at least min_m minimizers in common."""
    a = inc.select("mx", F.col("bx").alias("u"))
    b = inc.select("mx", F.col("bx").alias("v"))
    return a.join(b, (a["mx"] == b["mx"]) & (a["u"] < b["v"])).groupBy("u", "v").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= min_m)


def overlap_vertices(inc: DataFrame) -> DataFrame:
    """All groups, with the sizes of their sets."""
    return set_sizes(inc).select(F.col("bx").alias("id"), F.col("n").alias("m"))
