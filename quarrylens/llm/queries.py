"""The queries of the operators, one each, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.alignment import align_tokenizers
from quarrylens.llm.decontaminate import find_leaks
from quarrylens.llm.license_scan import scan_licenses
from quarrylens.llm.line_dedup import dedup_lines
from quarrylens.llm.near_dedup import near_duplicates
from quarrylens.llm.oracles import ORACLES  # noqa: F401
from quarrylens.llm.packing import pack
from quarrylens.llm.prefix_trie import prefix_trie, with_shared_starts
from quarrylens.llm.quality import quality
from quarrylens.llm.scoring import score_documents
from quarrylens.llm.simhash import simhash_duplicates
from quarrylens.llm.suffix_dedup import remove_repeats
from quarrylens.llm.token_counts import count_tokens
from quarrylens.llm.token_files import token_table
from quarrylens.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_lm_scoring(spark: SparkSession, directory: str) -> DataFrame:
    """Word unigram and subword lattice score of every document."""
    return score_documents(table(spark, directory, "documents"))


@query
def op2_line_dedup(spark: SparkSession, directory: str) -> DataFrame:
    """Lines, dropped lines and checksum of what is left, of every document."""
    found = dedup_lines(table(spark, directory, "documents"))
    return found.select("doc_id", "lines", "dropped_lines", F.md5("text").alias("kept_md5"))


@query
def op3_token_files(spark: SparkSession, directory: str) -> DataFrame:
    """Start, length and checksum of every document, from the token files."""
    found = token_table(table(spark, directory, "documents"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op4_license_scan(spark: SparkSession, directory: str) -> DataFrame:
    """License phrases, labels and the number of fuzzy spans of every document."""
    found = scan_licenses(table(spark, directory, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"),
        "score", F.size("spans").cast("bigint").alias("n_spans"),
    )


@query
def op5_suffix_dedup(spark: SparkSession, directory: str) -> DataFrame:
    """Bytes, removed bytes and runs, and checksum of what is left, of every document."""
    found = remove_repeats(table(spark, directory, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op6_token_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return count_tokens(table(spark, directory, "documents"))


@query
def op7_quality(spark: SparkSession, directory: str) -> DataFrame:
    """Base figures and verdict of every document."""
    found = quality(table(spark, directory, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op8_packing(spark: SparkSession, directory: str) -> DataFrame:
    """Every piece of every document, by sequence."""
    found = pack(table(spark, directory, "documents"))
    return found.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op9_benchmark_leaks(spark: SparkSession, directory: str) -> DataFrame:
    """Every document and benchmark item of which it holds a passage."""
    return find_leaks(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


@query
def op10_near_duplicates(spark: SparkSession, directory: str) -> DataFrame:
    """Shingles, component and verdict of every document, at 2-word shingles and 80 percent."""
    return near_duplicates(table(spark, directory, "documents"), size=2, percent=80)


@query
def op11_prefix_trie(spark: SparkSession, directory: str) -> DataFrame:
    """Every node of the trie of the conversations, which share the starts of every fifth one."""
    return prefix_trie(table(spark, directory, "conversations"), with_shared_starts)


@query
def op12_tokenizer_alignment(spark: SparkSession, directory: str) -> DataFrame:
    """Tokens, groups and links of both tokenizers of every document, and the digest of its groups."""
    return align_tokenizers(table(spark, directory, "documents"))


@query
def op13_simhash(spark: SparkSession, directory: str) -> DataFrame:
    """Fingerprint and component of every document, at 3-word shingles and 3 bits."""
    return simhash_duplicates(table(spark, directory, "documents"))
