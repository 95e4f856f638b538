"""PAF rows chained to segments, and minimizer places turned to base pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The chromosomes that reports show, and the least lengths and qualities.
CHROMOSOMES = [f"chr{i}" for i in range(1, 23)] + ["chrX", "chrY"]
MIN_TLENGTH, MIN_MAPQ = 50, 1
QUERY_GAP, TARGET_GAP = 500_000, 10
MIN_BARCODES, FALLBACK_BARCODES = 50, 10


def report_rows(paf: DataFrame, chromosomes: list[str] | None = None) -> DataFrame:
    """Rows of known chromosomes with a target that is long enough and a quality above zero."""
    return paf.where(F.col("qname").isin(chromosomes or CHROMOSOMES) & (F.col("tlength") >= MIN_TLENGTH) & (F.col("mapq") >= MIN_MAPQ))


def best_by_place(paf: DataFrame) -> DataFrame:
    """Of the rows at one target place the one with the greatest score, then the first query name."""
    return paf.withColumn("__r", F.row_number().over(W.partitionBy("tname", "tstart").orderBy(F.desc("score"), "qname", "qstart"))).where("__r = 1").drop("__r")


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether closed intervals [a, b] and [c, d] meet."""
    return (c <= b) & (a <= d)


def distance(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.when(overlaps(a, b, c, d), F.lit(0)).otherwise(F.greatest(c - b, a - d))


def chain_alignments(paf: DataFrame, query_gap: int = QUERY_GAP, target_gap: int = TARGET_GAP, min_rows: int = MIN_BARCODES, fallback: int = FALLBACK_BARCODES) -> DataFrame:
    """Segments of rows of one query and target that follow one another; if none has min_rows rows, those with fallback."""
    by = W.partitionBy("qname", "tname").orderBy("tstart", "qstart", "qend")
    near = lambda off: overlaps(F.lag("qstart", off).over(by), F.lag("qend", off).over(by), F.col("qstart"), F.col("qend"))
    kept = paf.where(F.col("mapq") >= MIN_MAPQ).withColumn("__k", F.coalesce(near(1), F.lit(False)) | F.coalesce(near(-1), F.lit(False))).where("__k")
    prev = {c: F.lag(c).over(by) for c in ("qstart", "qend", "tstart", "tend")}
    far = (distance(prev["qstart"], prev["qend"], F.col("qstart"), F.col("qend")) >= query_gap) | (distance(prev["tstart"], prev["tend"], F.col("tstart"), F.col("tend")) >= target_gap)
    parts = kept.withColumn("__new", F.coalesce(far, F.lit(False)).cast("int")).withColumn("segment", F.sum("__new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    votes = parts.groupBy("qname", "tname", "segment", "orientation").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("tstart", "qstart", "qend")).alias("first"))
    vote = votes.groupBy("qname", "tname", "segment").agg(F.min_by("orientation", F.struct(-F.col("c"), F.col("first"))).alias("orientation"))
    mapqs = F.array_sort(F.collect_list("mapq"))
    seg = parts.groupBy("qname", "tname", "segment").agg(
        F.min("qlength").alias("qlength"), F.min("qstart").alias("qstart"), F.max("qend").alias("qend"), F.min("tlength").alias("tlength"), F.min("tstart").alias("tstart"), F.max("tend").alias("tend"),
        F.sum("score").alias("score"), F.sum("length").alias("length"), F.element_at(mapqs, (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int")).alias("mapq"), F.count(F.lit(1)).alias("barcodes"),
    ).join(vote, ["qname", "tname", "segment"])
    top = seg.agg(F.max("barcodes").alias("__top"))  # one row
    return seg.join(F.broadcast(top)).where(F.col("barcodes") >= F.when(F.col("__top") >= min_rows, min_rows).otherwise(fallback)).drop("__top")


def places_to_bp(points: DataFrame, positions: DataFrame) -> DataFrame:
    """points (chrom, x, qlength) with ``bp``: x on the line through the nearest mapped minimizers, held at both ends.

    x is scaled first where the points' query length is not the map's.  Each
    stretch of the map is a row with its own ends, so the as-of join is one
    window over points and map rows together, per chromosome.
    """
    total = positions.groupBy("chrom").agg(F.max("total").alias("total"))
    p = points.join(total, "chrom", "left")
    x = F.when((F.col("qlength") != 0) & (F.col("total") != 0) & (F.col("qlength") != F.col("total")), F.col("x") * (F.col("total") / F.col("qlength"))).otherwise(F.col("x").cast("double"))
    p = p.select("chrom", F.col("x").alias("x0"), "qlength", x.alias("x"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("m"), F.lit(None).cast("long").alias("b"))
    m = positions.select("chrom", F.lit(None).cast(points.schema["x"].dataType).alias("x0"), F.lit(None).cast(points.schema["qlength"].dataType).alias("qlength"), F.col("mx_index").cast("double").alias("x"), F.lit(0).alias("kind"), F.col("mx_index").alias("m"), F.col("bp").alias("b"))
    by = W.partitionBy("chrom").orderBy("x", "kind")
    rows = p.unionByName(m)
    at = F.when(F.col("kind") == 0, F.struct("m", "b"))
    rows = rows.withColumns({"lo": F.last(at, True).over(by.rowsBetween(W.unboundedPreceding, 0)), "hi": F.first(at, True).over(by.rowsBetween(1, W.unboundedFollowing))})
    between = F.col("lo.b") + (F.col("x") - F.col("lo.m")) / (F.col("hi.m") - F.col("lo.m")) * (F.col("hi.b") - F.col("lo.b"))
    bp = F.when(F.col("lo").isNull() & F.col("hi").isNull(), F.col("x")).when(F.col("lo").isNull(), F.col("hi.b")).when(F.col("hi").isNull() | (F.col("hi.m") == F.col("lo.m")), F.col("lo.b")).otherwise(between)
    return rows.where("kind = 1").select("chrom", F.col("x0").alias("x"), "qlength", bp.cast("double").alias("bp"))


def top_targets(segments: DataFrame, n: int = 25) -> DataFrame:
    """The n targets with most barcodes."""
    return segments.groupBy("tname").agg(F.sum("barcodes").alias("barcodes")).orderBy(F.desc("barcodes"), "tname").limit(n)
