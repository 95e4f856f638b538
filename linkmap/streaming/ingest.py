"""Reads that arrive as a stream, gathered into an incidence table.

A set union does not care for order or repetition, so late and repeated files
are harmless: each batch is appended, and readers take the distinct rows.  A
batch that is replayed after a failure overwrites its own part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkmap.operators import sequences


def start(reads: DataFrame, table: str, checkpoint: str, k: int, w: int, once: bool = False) -> StreamingQuery:
    """Write each batch's distinct (bx, mx) below ``table``; reads: a streaming frame of header and seq."""

    def batch(df: DataFrame, number: int) -> None:
        sequences.index_linked(df, k, w).write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch={number}")

    out = reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def incidence(spark: SparkSession, table: str) -> DataFrame:
    """The union of all batches so far."""
    return spark.read.parquet(table).select("bx", "mx").distinct()


def counts_by_window(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Reads by barcode and time window, with a watermark for late ones; events: ts, header."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), sequences.read_key().alias("bx")).agg(F.count(F.lit(1)).alias("n"))
