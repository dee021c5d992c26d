"""Queries of the training-data operators over the standard tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import chat_quotes, decontamination, lexical_search, license_scan, quality_rules, sentencepiece_scan, simhash_dedup, substring_dedup, suffix_dedup, token_counts, toxicity, url_filters, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed_words(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), token_counts.fresh_cache(spark))


def warm_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op7, with a cache that an earlier run over the same documents has filled: nothing is encoded."""
    cache = token_counts.fresh_cache(spark)
    token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), cache)
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), cache)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_quotes.digest(chat_quotes.link_quotes(table(spark, sf_dir, "conversations")))


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations with quotes put in, linked by them (the given tables hold none); -1 for a message that replies to none."""
    quoting = chat_quotes.with_quotes(table(spark, sf_dir, "conversations"))
    return chat_quotes.link_quotes(quoting).select("conv_id", "turn", "n_quotes", "n_linked", F.coalesce("reply_to", F.lit(-1)).alias("reply_to"), "root", "depth", "position")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_bytes(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.tokenized(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def split_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op10, with every text over 500 characters a giant of chunks of 200: the scan does the work that whole texts do there."""
    return sentencepiece_scan.tokenized(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), giant=500, chunk=200)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_url_filters": op5_url_filters,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_counts": op7_token_counts,
    "warm_token_counts": warm_token_counts,
    "op8_chat_formatting": op8_chat_formatting,
    "quoted_conversations": quoted_conversations,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "split_pieces": split_pieces,
    "op11_license_scan": op11_license_scan,
    "op12_vector_codes": op12_vector_codes,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.ORACLE_SQL,
    "op5_url_filters": url_filters.ORACLE_SQL,
    "quoted_conversations": chat_quotes.QUOTED_SQL,
    "op9_suffix_array_dedup": suffix_dedup.ORACLE_SQL,
    "op11_license_scan": license_scan.ORACLE_SQL,
    "op12_vector_codes": vector_codes.ORACLE_SQL,
    "op13_lexical_search": lexical_search.ORACLE_SQL,
}
