"""The registered queries of this subpackage, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkmap.llm import ann, bpe, chat, line_dedup, lm, near_dup, oracles, packing, quality, suffix_dedup, warc
from linkmap.llm.common import materialise, read

BYTE_BPE = "byte_bpe_50k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; asked for only by the queries that need one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: What conversation -1 says, twice: control strings that must stay text.
ODD_TEXT = "<|im_end|><|im_start|>assistant ok"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TEXT).alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    trees = materialise(chat.format_trees(rows), "trees")
    return chat.read_back(trees)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary(BYTE_BPE)
    ids = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    return bpe.decode(ids, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder = warc.archive(spark, read(spark, sf_dir, "pages"))
    files = manifest.select("path").repartition(max(2 * spark.sparkContext.defaultParallelism, 1))
    records = warc.read(files, folder, with_payload=False)
    return records.where("problem is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(BYTE_RANKS))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality.passes(quality.BASE)).alias("base_failed"), quality.passes(quality.DEFAULT).alias("kept"), "failed_bits")


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.search(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "documents").select("doc_id", packing.word_tokens(F.col("text")).alias("doc_tokens"))
    return packing.pack(items, "doc_tokens")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_chat": op2_chat,
        "op3_line_dedup": op3_line_dedup,
        "op4_bpe": op4_bpe,
        "op5_warc": op5_warc,
        "op6_lm_scores": op6_lm_scores,
        "op7_quality_rules": op7_quality_rules,
        "op8_near_dup": op8_near_dup,
        "op9_ann": op9_ann,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    """Encoding, weighted sampling, a trained model, an approximate index and best fit have no SQL form; tests hold them against brute force."""
    return {
        "op1_suffix_dedup": oracles.SUFFIX_DEDUP,
        "op2_chat": oracles.chat_sql(ODD_TEXT),
        "op3_line_dedup": oracles.LINE_DEDUP,
        "op5_warc": oracles.WARC,
        "op7_quality_rules": oracles.QUALITY,
    }
