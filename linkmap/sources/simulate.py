"""Linked reads of a known sequence: barcodes, molecules of each, and reads of these with errors.

All chance is a hash of the seed and the numbers of barcode, molecule, read
and base, so the same reads come out however the work is cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkmap.functions import columns as C
from linkmap.operators.numbers import running_sums

#: Bases of a piece of the reference that a read is cut from.
PIECE = 1 << 16
BARCODE, LEAST_READ, MOST_MOLECULES, LEAST_MOLECULE = 16, 50, 30, 1000


@dataclass(frozen=True)
class Simulation:
    barcodes: int = 500
    molecules: float = 5.0
    molecule_size: float = 50_000.0
    molecule_spread: float = 10_000.0
    reads: int = 40
    read_length: int = 150
    error_rate: float = 0.001
    seed: int = 42


def _hash(seed: int, kind: str, *of: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(kind), *of)


def _share(h: Column) -> Column:
    """A number from 0 up to 1 of a hash."""
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)


def simulate_reads(reference: DataFrame, p: Simulation | None = None) -> DataFrame:
    """(rec_no, header, seq, qual, barcode, molecule, name, start, reverse) of reads of a reference (name, seq); start is the read's place on the forward strand."""
    p = p or Simulation()
    spark = reference.sparkSession
    lengths = reference.select("name", F.length("seq").cast("long").alias("n")).where("n > 0")
    total, sequences = lengths.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    if not total:
        return spark.createDataFrame([], "rec_no long, header string, seq string, qual string, barcode string, molecule long, name string, start long, reverse boolean")
    b, m, r = F.col("b"), F.col("m"), F.col("r")
    wide = F.floor(-F.log(1 - _share(_hash(p.seed, "molecules", b))) * p.molecules)
    count = F.least(F.greatest(wide, F.lit(1).cast("long")), F.lit(MOST_MOLECULES).cast("long"))
    mols = spark.range(p.barcodes).withColumnRenamed("id", "b").select("b", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("m"))
    # a normal variate of two uniform ones
    spread = F.sqrt(-2 * F.log(1 - _share(_hash(p.seed, "size", b, m)))) * F.cos(6.283185307179586 * _share(_hash(p.seed, "angle", b, m)))
    mols = mols.withColumn("want", F.greatest(F.lit(LEAST_MOLECULE), F.floor(F.lit(p.molecule_size) + spread * p.molecule_spread))).withColumn("at", F.floor(_share(_hash(p.seed, "sequence", b, m)) * total))
    # a sequence is met with the chance of its length: by the bin of the place among all bases
    width = max(1, total // sequences)
    named = lengths.groupBy("name").agg(F.sum("n").alias("n"))
    ranges = running_sums(named, ["name"], "n", "upto").withColumn("lo", F.col("upto") - F.col("n"))
    binned = ranges.select("name", "n", "lo", "upto", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("upto") - 1) / width))).alias("bin"))
    placed = mols.withColumn("bin", F.floor(F.col("at") / width)).join(binned, "bin").where("at >= lo and at < upto")
    size = F.least("want", "n")
    placed = placed.withColumn("size", size).withColumn("begin", F.floor(_share(_hash(p.seed, "begin", b, m)) * (F.col("n") - size + 1)))
    reads = placed.select("b", "m", "name", "size", "begin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p.reads - 1).cast("long"))).alias("r"))
    room = F.greatest(F.col("size") - p.read_length, F.lit(0).cast("long"))
    reads = reads.withColumn("start", F.col("begin") + F.floor(_share(_hash(p.seed, "read", b, m, r)) * (room + 1)))
    reads = reads.withColumn("length", F.least(F.lit(p.read_length).cast("long"), F.col("begin") + F.col("size") - F.col("start"))).where(F.col("length") >= LEAST_READ).withColumn("piece", F.floor(F.col("start") / PIECE))
    pieces = reference.select("name", "seq", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("seq") - 1) / PIECE))).alias("piece")).select("name", "piece", F.substring("seq", (F.col("piece") * PIECE + 1).cast("int"), F.lit(PIECE + p.read_length)).alias("part"))
    met = reads.join(pieces, ["name", "piece"]).withColumn("seq", F.upper(F.substring("part", (F.col("start") - F.col("piece") * PIECE + 1).cast("int"), F.col("length").cast("int"))))
    if p.error_rate > 0:

        def base(x: Column, i: Column) -> Column:
            h = _hash(p.seed, "error", b, m, r, i)
            return F.when((_share(h) < p.error_rate) & F.lit("ACGT").contains(x), F.substring(F.replace(F.lit("ACGT"), x, F.lit("")), (F.pmod(h, F.lit(3)) + 1).cast("int"), F.lit(1))).otherwise(x)

        met = met.withColumn("seq", F.array_join(F.transform(F.split("seq", ""), base), ""))
    met = met.withColumn("reverse", _hash(p.seed, "strand", b, m, r).bitwiseAND(F.lit(1)) == 1)
    letters = F.transform(F.sequence(F.lit(0), F.lit(BARCODE - 1)), lambda i: F.substring(F.lit("ACGT"), (F.pmod(_hash(p.seed, "barcode", b, i), F.lit(4)) + 1).cast("int"), F.lit(1)))
    number = (b * MOST_MOLECULES + m) * p.reads + r
    out = met.select(number.alias("rec_no"), F.concat(F.array_join(letters, ""), F.lit("-1")).alias("barcode"), F.when(F.col("reverse"), C.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), "m", "name", "start", "reverse")
    return out.select("rec_no", F.concat(F.lit("read"), F.col("rec_no"), F.lit(" BX:Z:"), F.col("barcode")).alias("header"), "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual"), "barcode", F.col("m").alias("molecule"), "name", "start", "reverse")
