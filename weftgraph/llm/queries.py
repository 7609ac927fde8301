"""The queries of this subpackage, each over its whole table with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import hard_negatives, line_dedup, prefix_trie, url_filters, warc
from weftgraph.llm.decontaminate import decontaminate
from weftgraph.llm.embedding_dedup import near_vectors
from weftgraph.llm.html_text import extract_text
from weftgraph.llm.language_id import identify
from weftgraph.llm.licenses import scan_licenses
from weftgraph.llm.near_dedup import near_duplicates
from weftgraph.llm.packing import pack
from weftgraph.llm.token_counts import token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 4096, 1)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "text", "n_lines", "n_removed")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.98)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), 10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_paragraphs", F.size("notices").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("notices.family")), ",").alias("families"),
        F.coalesce(F.array_max("notices.probability"), F.lit(0.0)).alias("score"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"), revisit_bytes=0)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 1024)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.filter_urls(url_filters.page_captures(pages), url_filters.page_entries(pages)).withColumn("fetched", F.col("fetched").cast("string"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op12_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row has the label after its own; anchors are every fiftieth."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), hard_negatives.integer_vector("embedding").alias("vec"))
    return hard_negatives.hard_negatives(vectors, F.col("id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_warc": op8_warc,
    "op9_token_counts": op9_token_counts,
    "op10_url_filters": op10_url_filters,
    "op11_html_extraction": op11_html_extraction,
    "op12_hard_negative_mining": op12_hard_negative_mining,
    "op13_conversation_prefix_trie": op13_conversation_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": line_dedup.SQL,
    "op8_warc": warc.SQL,
    "op10_url_filters": url_filters.SQL,
    "op12_hard_negative_mining": hard_negatives.SQL,
    "op13_conversation_prefix_trie": prefix_trie.SQL,
}
