"""Line deduplication across documents.

Lines are normalised and hashed, documents are counted per hash, and lines
whose key is in too many documents go from all of them but the one with the
largest id.  What stays is put together again by position.

Only keys, ids and positions are shuffled for the counts; a text moves once,
to meet the positions that it loses.  Counting goes by (key, document) first,
so a key that a third of all documents hold is spread over all tasks.  The
keys over the threshold are written before the lines meet them: the join then
is a broadcast one while they are few, and else one whose hot keys Spark splits.

Defined results: a null or empty text is one empty line and stays as the empty
text; a document is known by its id, so several rows with one id count once
and each loses its lines; rows without an id count as one document below all
others; repeated rows stay; an empty table gives an empty table; other columns
pass through, and ``n_lines`` and ``n_dropped`` replace columns of that name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkmap.llm.common import SPACE, materialise, tune

_SPACE = SPACE.encode()


def line_keys(text: str, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """(position, digest of the key) of a text's lines whose key is long enough.

    The key is the line without white space at its ends, A-Z in lower case.
    """
    for i, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        line = line.strip(_SPACE)
        if len(line) >= min_chars and (line.isascii() or len(line.decode("utf-8", "replace")) >= min_chars):
            yield i, hashlib.md5(line.lower()).digest()  # of bytes, so only A-Z change


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with ``text`` reduced to the lines that stay, ``n_lines`` and ``n_dropped``."""
    tune(docs.sparkSession)
    text = F.coalesce(F.col(text_column), F.lit(""))
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pos, key = [], [], []
            for k, t in enumerate(b.column(2).to_pylist()):
                for i, digest in line_keys(t, min_chars):
                    at.append(k)
                    pos.append(i)
                    key.append(digest)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(pos, pa.int32()), pa.array(key, pa.binary())], names=["__id", "__text", "__pos", "__key"])

    id_type = docs.select(F.col(id_column).alias("__id")).schema[0]
    fields = [id_type, T.StructField("__text", T.LongType()), T.StructField("__pos", T.IntegerType()), T.StructField("__key", T.BinaryType())]
    lines = docs.select(F.col(id_column).alias("__id"), F.xxhash64(text).alias("__text"), text).mapInArrow(keys, T.StructType(fields))
    frequent = materialise(
        lines.groupBy("__key", "__id").agg(F.lit(1).alias("__one"))
        .groupBy("__key").agg(F.count("__one").alias("__n"), F.max("__id").alias("__last"))
        .where(F.col("__n") >= min_docs)
        .select("__key", "__last"),
        "frequent",
    )
    lost = (
        lines.join(frequent, "__key")
        .where(~F.col("__id").eqNullSafe(F.col("__last")))
        .groupBy("__id", "__text").agg(F.collect_set("__pos").alias("__lost"))
    )
    own = docs.drop("n_lines", "n_dropped").withColumn("__text", F.xxhash64(text))
    met = own.join(lost, own[id_column].eqNullSafe(lost["__id"]) & (own["__text"] == lost["__text"]), "left").drop("__id", "__text")
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("n_lines", "n_dropped")]
    schema = T.StructType(kept + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lost_at = b.column(b.num_columns - 1)
            texts, n_lines, n_dropped = [], [], []
            for t, gone in zip(b.column(b.schema.get_field_index(text_column)).to_pylist(), lost_at.to_pylist(), strict=True):
                t = t or ""
                if gone:
                    gone = set(gone)
                    parts = t.split("\n")
                    n_lines.append(len(parts))
                    t = "\n".join([x for i, x in enumerate(parts) if i not in gone])
                else:
                    n_lines.append(t.count("\n") + 1)
                n_dropped.append(len(gone or ()))
                texts.append(t)
            columns = [pa.array(texts, pa.string()) if f.name == text_column else b.column(i) for i, f in enumerate(kept)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=schema.names)

    return met.select(*[F.col(f"`{f.name}`") for f in kept], "__lost").mapInArrow(reassemble, schema)
