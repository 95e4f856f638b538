"""The molecule graph, and the minimizers of molecules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkmap.functions import columns as C
from linkmap.operators.filters import endpoints


def molecule_name(bx, mol):
    return F.concat_ws("_", bx, mol.cast("string"))


def molecule_edges(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """Edges whose two ends each have the other in one of their molecules, between those molecules; u < v."""
    of_u = assigned.select("u", "v", F.col("mol").alias("mu"))
    of_v = assigned.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("mol").alias("mv"))
    met = edges.join(of_u, ["u", "v"]).join(of_v, ["u", "v"])
    a, b = molecule_name(F.col("u"), F.col("mu")), molecule_name(F.col("v"), F.col("mv"))
    return met.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), "m")


def molecule_graph(vertices: DataFrame, edges: DataFrame, assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices with m of their barcode and mol, edges); molecules without edges are left out."""
    e = molecule_edges(edges, assigned)
    ids = endpoints(e).distinct().withColumn("bx", C.barcode_of_molecule(F.col("id")))
    m = vertices.select(F.col("id").alias("bx"), "m")
    return ids.join(m, "bx", "left").select("id", F.coalesce("m", F.lit(0)).alias("m"), F.regexp_extract("id", "_([0-9]+)$", 1).cast("long").alias("mol")), e


def split_minimizers(mol_edges: DataFrame, lists: DataFrame) -> DataFrame:
    """(mol, qpos, mx): of each molecule's barcode's minimizers those that a neighbouring molecule's barcode has too, in order; a molecule without any has one row without mx.

    lists: (name, qpos, mx).
    """
    sides = F.array(F.struct(F.col("u").alias("mol"), F.col("v").alias("near")), F.struct(F.col("v").alias("mol"), F.col("u").alias("near")))
    near = mol_edges.select(F.explode(sides).alias("s")).select("s.mol", C.barcode_of_molecule(F.col("s.near")).alias("near")).distinct()
    around = near.join(lists.select(F.col("name").alias("near"), "mx").distinct(), "near").select("mol", "mx").distinct()
    mols = near.select("mol").distinct().withColumn("name", C.barcode_of_molecule(F.col("mol")))
    own = mols.join(lists, "name").join(around, ["mol", "mx"], "left_semi").select("mol", "qpos", "mx")
    return mols.select("mol").join(own, "mol", "left")
