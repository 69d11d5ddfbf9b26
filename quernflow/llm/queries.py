"""The operators' queries: each takes (spark, sf_dir), applies its operator to the whole table with production
parameters and derives the digest columns. SQL is in `oracles`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_search, html_extract, lattice_lm, line_dedup, quality_rules, simhash, url_filter
from .chunk_bpe import encode_documents
from .common import table
from .packing import pack_documents
from .token_files import token_files

#: Where the vocabulary files lie; a parameter of every operator that needs one.
WORD_BPE = "word_bpe_49k.json"


def vocabulary(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return block_search.search(vectors, vectors.where("vec_id % 100 = 0"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    rows, at, failed, kept = quality_rules.judge(docs, rules)
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", *[F.col(at[k]).alias(k) for k in base], F.col(failed).alias("base_failed"), F.col(kept).alias("kept"))


def op4_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_documents(table(spark, sf_dir, "documents"), vocabulary())
    return rows.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_chunks",
        "n_reused",
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_files(table(spark, sf_dir, "documents"), vocabulary())
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, n_lines, n_dropped = line_dedup.dedup_lines(docs)
    return rows.select(
        "doc_id",
        F.col(n_lines).alias("n_lines"),
        F.col(n_dropped).alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pack_documents(table(spark, sf_dir, "documents"), vocabulary())
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extract": op1_html_extract,
        "op2_block_search": op2_block_search,
        "op3_quality_rules": op3_quality_rules,
        "op4_chunk_bpe": op4_chunk_bpe,
        "op5_url_filter": op5_url_filter,
        "op6_token_files": op6_token_files,
        "op7_line_dedup": op7_line_dedup,
        "op8_packing": op8_packing,
        "op9_lattice_lm": op9_lattice_lm,
        "op10_simhash": op10_simhash,
    }
