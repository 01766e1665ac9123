"""One query per operator, applied to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dashframe.llm import (bpe, interpolated_lm, language_id, line_dedup, ngram_join, page_text,
                           part_codes, pii, prefix_trie, quality, token_files, toxicity, winnow)
from dashframe.llm.common import table

QUERIES: dict = {}
SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.round_trip(table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                          public_tokenizers.PATTERN)


@query
def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.contamination(table(spark, sf_dir, "documents"),
                                table(spark, sf_dir, "benchmark")).drop("text_key")


SQL["op4_winnowing"] = winnow.SQL


@query
def op8_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("text_key")


@query
def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@query
def op5_set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents")).drop("text_key", "class")


SQL["op5_set_relations"] = ngram_join.SQL


@query
def op7_bit_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_files.read(token_files.write(table(spark, sf_dir, "documents"),
                                              public_tokenizers.path("byte_bpe_50k.json")))


@query
def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.scores(table(spark, sf_dir, "documents"))


@query
def op1_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query
def op3_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


@query
def op11_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


SQL["op11_part_codes"] = part_codes.SQL


@query
def op12_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages"))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


SQL["op13_prefix_trie"] = prefix_trie.SQL
