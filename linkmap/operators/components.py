"""Connected components by least labels and pointer jumping, on DataFrames only."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@lru_cache
def _own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="linkmap-")


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write to the folder in spark.checkpoint.dir and read back; a local session without that setting gets a folder of its own."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own_dir(spark.sparkContext.applicationId)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, u: str = "u", v: str = "v", vertex: str = "id") -> DataFrame:
    """(id, component): component is the least id that a vertex reaches.

    Each round sends labels over the edges, combined before the shuffle, and
    then follows each label to its own label, so long paths shrink by halves.
    A vertex with very many edges is a hot join key that Spark can split and
    an aggregate that is combined in advance.  Vertices without edges are
    their own component; self-loops and repeated edges change nothing.
    """
    both = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a <> b")
    both = cut_lineage(both.union(both.select("b", "a")).distinct(), "edges")
    labels = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        sent = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("m"))
        met = labels.join(sent, labels["id"] == sent["a"]).select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = met.select(F.col("id").alias("j"), F.col("label").alias("further"))
        new = cut_lineage(met.join(jump, met["label"] == jump["j"]).select("id", "old", F.least("label", "further").alias("label")), "labels")
        labels = new.select("id", "label")
        if new.where("label <> old").isEmpty():
            break
    found = labels.withColumnRenamed("label", "component")
    if vertices is None:
        return found.withColumnRenamed("id", vertex)
    own = vertices.select(F.col(vertex)).distinct()
    return own.join(found, own[vertex] == found["id"], "left").select(own[vertex], F.coalesce("component", own[vertex]).alias("component"))
