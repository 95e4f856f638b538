"""Filters and counts over incidence(bx, mx), and over graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkmap.functions.order_stats import nth_values
from linkmap.operators.components import connected_components


def frequency(inc: DataFrame) -> DataFrame:
    """(mx, df): in how many groups a minimizer occurs."""
    return inc.groupBy("mx").agg(F.count(F.lit(1)).alias("df"))


def set_sizes(inc: DataFrame) -> DataFrame:
    return inc.groupBy("bx").agg(F.count(F.lit(1)).alias("n"))


def union_sets(*incidences: DataFrame) -> DataFrame:
    """The union of several files' sets, group by group."""
    out = incidences[0].select("bx", "mx")
    for x in incidences[1:]:
        out = out.unionByName(x.select("bx", "mx"))
    return out.distinct()


def filter_barcodes(inc: DataFrame, min_n: int, max_n: int) -> DataFrame:
    """Groups with at least min_n and fewer than max_n minimizers."""
    good = set_sizes(inc).where((F.col("n") >= min_n) & (F.col("n") < max_n)).select("bx")
    return inc.join(good, "bx", "left_semi")


def barcode_counts(inc: DataFrame, min_n: int, max_n: int) -> DataFrame:
    """One row: groups that filter_barcodes drops on either side."""
    return set_sizes(inc).agg(F.count_if(F.col("n") < min_n).alias("too_few"), F.count_if(F.col("n") >= max_n).alias("too_many"))


def remove_singletons(inc: DataFrame) -> DataFrame:
    """Minimizers of one group only go."""
    return inc.join(frequency(inc).where("df >= 2").select("mx"), "mx", "left_semi").select("bx", "mx")


def repetitive_threshold(inc: DataFrame) -> DataFrame:
    """One row: q1 and q3 of the frequencies by integer rank, and q3 plus one and a half times their distance, cut to an integer."""
    n = F.col("n")
    q = nth_values(frequency(inc), "df", {"q1": F.floor(n / 4), "q3": F.floor(3 * n / 4)})
    return q.select("q1", "q3", (F.col("q3") + F.floor(1.5 * (F.col("q3") - F.col("q1"))).cast("long")).alias("threshold"))


def remove_repetitive(inc: DataFrame, most: int = 0) -> DataFrame:
    """Minimizers with a frequency at or above most (0: the threshold from the quartiles) go."""
    df = frequency(inc)
    if most:
        good = df.where(F.col("df") < most)
    else:
        good = df.join(F.broadcast(repetitive_threshold(inc).select("threshold"))).where(F.col("df") < F.col("threshold"))  # one row
    return inc.join(good.select("mx"), "mx", "left_semi").select("bx", "mx")


def filter_chain(inc: DataFrame, min_n: int, max_n: int) -> DataFrame:
    """Singletons, set sizes, singletons again, repetitive ones."""
    return remove_repetitive(remove_singletons(filter_barcodes(remove_singletons(inc), min_n, max_n)))


def inverted_index(inc: DataFrame) -> DataFrame:
    return inc.groupBy("mx").agg(F.sort_array(F.collect_set("bx")).alias("bxs"))


def filter_edges(edges: DataFrame, min_m: int) -> DataFrame:
    return edges.where(F.col("m") >= min_m) if min_m > 0 else edges


def filter_by_percentile(edges: DataFrame, percentile: float) -> DataFrame:
    """Edges lighter than the weight at rank trunc(n p / 100) go; ties with it stay."""
    if percentile <= 0:
        return edges
    at = nth_values(edges, "m", {"least": F.least(F.floor(F.col("n") * F.lit(percentile) / 100), F.col("n") - 1)})
    return edges.join(F.broadcast(at)).where(F.col("m") >= F.col("least")).drop("least")  # one row


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("id"))


def remove_isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.join(endpoints(edges).distinct(), "id", "left_semi")


def remove_small_components(vertices: DataFrame, edges: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of the components with at least size members; a size below 2 changes nothing."""
    if size < 2:
        return vertices, edges
    comp = connected_components(edges, vertices)
    good = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= size).select("component")
    kept = comp.join(good, "component", "left_semi").select("id")
    return vertices.join(kept, "id", "left_semi"), edges.join(kept.withColumnRenamed("id", "u"), "u", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    return endpoints(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def top_degrees(edges: DataFrame, n: int = 5) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(n)


def graph_stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.agg(F.count(F.lit(1)).alias("n_vertices")).crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges"), F.coalesce(F.sum("m"), F.lit(0)).alias("total_m")))  # one row each
