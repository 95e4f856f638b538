"""The corpus pipeline: quality rules, line dedup, near-dedup, suffix dedup, packing.

Each stage takes the documents that its predecessor kept, and calls one
operator of ``linkmap.llm``.  All stages but the last return the columns of
``documents`` with their types, whatever they are named, with ``n_chars``
brought up to date where there is one.  Texts of any length, repeated rows,
rows without id and empty tables pass through every stage; the operators state
what happens to each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkmap.llm import line_dedup, near_dup, packing, quality, suffix_dedup
from linkmap.llm.common import discard, materialise, read, shared_dir


#: The caller's other columns travel in one struct, so that none clashes with what an operator adds.
OTHERS = "others"


def _plain(docs: DataFrame) -> DataFrame:
    """doc_id, text and a struct of all other columns."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*others).alias(OTHERS)] if others else []))


def _columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, with their types; ``n_chars`` is that of the text as it is now."""
    def one(c: str):
        if c in ("doc_id", "text"):
            return F.col(c)
        return F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(OTHERS)[c].alias(c)

    return rows.select(*[one(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the default policy; a null or empty text has too few words and goes."""
    return _columns(quality.ledger(_plain(docs)).where(quality.passes(quality.DEFAULT)), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that too many documents have; texts that lose all of their lines go, null texts become empty."""
    out = line_dedup.line_dedup(_plain(docs))
    return _columns(out.where((F.col("n_dropped") == 0) | (F.btrim("text", F.lit(line_dedup.SPACE)) != "")), docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one whose doc_id names the class; repeated rows of it and documents without id stay, as do texts without words."""
    out = near_dup.near_duplicates(_plain(docs))
    return _columns(out.where(F.col("doc_id").isNull() | (F.col("class_id") == F.col("doc_id"))), docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes and more that occur earlier; texts that lose all go, null texts become empty."""
    out = suffix_dedup.suffix_dedup(_plain(docs), length=100)
    return _columns(out.where((F.col("n_removed") == 0) | (F.btrim("text", F.lit(line_dedup.SPACE)) != "")), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each segment of each document with its place in a bin; a document without words has its end token only."""
    return packing.pack(docs.select("doc_id", packing.word_tokens(F.col("text")).alias("doc_tokens")), "doc_tokens")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dup", near_stage),
    ("suffix_dedup", suffix_stage),
    ("packing", packing_stage),
]

#: Weighted sampling and best-fit packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_dir(spark, f"stage-{name}")
            docs = materialise(docs, name, path)
            if before:  # the stage before was read for the last time
                discard(spark, before)
            before = path
    return docs
