"""Registered queries of the corpus operators: each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import (
    collocations,
    lines,
    merkle,
    mixing,
    neardup,
    packing,
    permutation,
    rules,
    sharding,
    surrogates,
    tokenfiles,
    toxicity,
    wrappers,
)
from shelfcast.llm.common import count_words
from shelfcast.llm.oracles import ORACLES
from shelfcast.plans.tables import table
from shelfcast.session import scratch_path

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest neighbours found of every fiftieth vector."""
    index = permutation.build_index(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    found = permutation.search(index, F.col("key") % 50 == 0, 5)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("key").alias("vec_id"), "score")


@query
def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and the verdict of the strict policy."""
    rows = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")), "strict-1")
    base = rules.mask_of(rules.BASE)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept", "failed")


@query
def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced."""
    return surrogates.replace_personal_data(table(spark, sf_dir, "documents"))


@query
def op4_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 contiguous shards of near-equal bytes."""
    rows = sharding.shard_documents(table(spark, sf_dir, "documents"), 24)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens."""
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", F.expr("octet_length(ids) div 4").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset")


@query
def op6_chosen_path_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each document under a similarity of 0.85."""
    rows = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"),
        (F.col("doc_id") == F.col("component")).alias("kept"))


@query
def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with one occurrence of each group of alike lines."""
    return lines.deduplicate_lines(table(spark, sf_dir, "documents"))


@query
def op8_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model fitted on the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    rows = wrappers.extract_main_text(table(spark, sf_dir, "pages"))
    return rows.select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_blocks", "n_template")


@query
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    rows = mixing.mix(table(spark, sf_dir, "documents"), count_words(F.col("text")))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "blocks")


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two to four words of each language."""
    return collocations.mine_phrases(table(spark, sf_dir, "documents"))


@query
def op12_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, read back from the files they were written to."""
    import public_tokenizers

    return tokenfiles.token_digests(
        table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; a third of them is folded with a text in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(third, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered)
