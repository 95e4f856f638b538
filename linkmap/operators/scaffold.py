"""Scaffolds: contigs joined along paths, and how long assemblies are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkmap.functions import columns as C
from linkmap.operators.numbers import row_numbers
from linkmap.types import ScaffoldParams


def scaffolds(contigs: DataFrame, paths: DataFrame, params: ScaffoldParams | None = None) -> DataFrame:
    """(id, name, seq): paths' contigs with gaps between, then the contigs that no path has used.

    contigs: (name, seq); paths: (tid, ord, name, orientation).  Paths whose
    contigs all lack an orientation are left out; contigs that are unknown
    are passed over; one without orientation stands forward.
    """
    p = params or ScaffoldParams()
    known = paths.join(contigs.select("name", "seq"), "name", "left")
    some = paths.groupBy("tid").agg(F.bool_or(F.col("orientation") != ".").alias("ok")).where("ok").select("tid")
    part = F.when(F.col("orientation") == "-", C.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    used_rows = known.join(some, "tid", "left_semi").where("seq is not null")
    joined = used_rows.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("ord", part.alias("s")))).alias("x"), F.count(F.lit(1)).alias("xn"))
    body = F.filter(F.transform("x", lambda e: e["s"]), lambda s: s != "")
    made = joined.select(F.lit(0).alias("kind"), F.col("tid").alias("key"), F.lit("").alias("cname"), F.array_join(body, "N" * p.gap).alias("seq"), "xn")
    single = contigs.join(used_rows.select("name").distinct(), "name", "left_anti").select(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("key"), F.col("name").alias("cname"), "seq", F.lit(1).cast("long").alias("xn"))
    rows = made.unionByName(single).where(F.length("seq") >= p.min_length)
    # only keys are put in order
    number = row_numbers(rows.select("kind", "key", "cname"), ["kind", "key", "cname"], "id").withColumn("id", F.col("id").cast("int"))
    return rows.join(number, ["kind", "key", "cname"]).select("id", F.concat(F.format_string("%07d", "id"), F.lit(" LN:i:"), F.length("seq"), F.lit(" xn:i:"), "xn").alias("name"), "seq")


def nx(lengths: DataFrame, fractions: dict[str, Column]) -> DataFrame:
    """One row: for each name the first length, longest first, at which the running sum reaches a target (an expression of column total), else 0; and its ordinal as name_l, else the number of lengths.

    Equal lengths are counted before the running sum, so the window has a row
    for each distinct length.
    """
    hist = lengths.where("length is not null").groupBy("length").agg(F.count(F.lit(1)).alias("c"))
    w = W.orderBy(F.desc("length"))
    run = hist.withColumns({
        "upto": F.sum(F.col("length") * F.col("c")).over(w.rowsBetween(W.unboundedPreceding, 0)),
        "rank": F.sum("c").over(w.rowsBetween(W.unboundedPreceding, 0)),
        "total": F.sum(F.col("length") * F.col("c")).over(W.partitionBy()),
        "n": F.sum("c").over(W.partitionBy()),
    })
    aggs = []
    for name, target in fractions.items():
        reached = F.col("upto") >= target
        # the ordinal at which the sum is reached lies within the equal lengths
        before = F.col("upto") - F.col("length") * F.col("c")
        steps = F.greatest(F.ceil((target - before) / F.greatest(F.col("length"), F.lit(1))), F.lit(1))
        aggs += [F.coalesce(F.max(F.when(reached, F.col("length"))), F.lit(0)).alias(name), F.coalesce(F.min(F.when(reached, F.col("rank") - F.col("c") + steps)), F.max("n"), F.lit(0)).alias(f"{name}_l")]
    return run.agg(*aggs)


def _share(p: float, total: Column) -> Column:
    return F.floor(F.lit(p) * total)


def length_metrics(lengths: DataFrame, genome: int | None = None) -> DataFrame:
    """n, total, max, min, mean, N50, N75, L50, L75, NG50, NG75 (null without a genome size) of column length."""
    total = F.col("total")
    wanted = {"n50": _share(0.5, total), "n75": _share(0.75, total)}
    if genome is not None:
        wanted |= {"ng50": F.lit(int(genome * 0.5)), "ng75": F.lit(int(genome * 0.75))}
    plain = lengths.agg(F.count("length").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total"), F.coalesce(F.max("length"), F.lit(0)).alias("max"), F.coalesce(F.min("length"), F.lit(0)).alias("min"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean"))
    x = nx(lengths, wanted)
    null = F.lit(None).cast("long")
    cols = ["n50", "n75", F.col("n50_l").alias("l50"), F.col("n75_l").alias("l75")] + (["ng50", "ng75"] if genome is not None else [null.alias("ng50"), null.alias("ng75")])
    return plain.crossJoin(x.select(*cols))  # one row each


def assembly_metrics(seqs: DataFrame, genome: int | None = None) -> DataFrame:
    return length_metrics(seqs.select(F.length("seq").cast("long").alias("length")), genome)


def path_metrics(paths: DataFrame, expected: int | None = None, min_size: int = 0) -> DataFrame:
    sizes = paths.groupBy("tid").agg(F.count(F.lit(1)).alias("length")).where(F.col("length") >= min_size)
    return length_metrics(sizes, expected)
