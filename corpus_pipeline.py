"""A training-data pipeline over ``documents``: quality rules, line dedup,
near-duplicate documents, benchmark decontamination, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and is written as Parquet before the
next one reads it.  All stages but the last return the columns they were given:

* quality rules: the documents that the rules reject go;
* line dedup: lines that another line is a (near) copy of go, and documents
  that keep no word;
* n-gram Jaccard join (five words, 0.8): of each class of documents the one with the smallest id
  stays;
* benchmark decontamination: contaminated documents go;
* byte-level BPE: ``doc_id, n_tokens, tokens, ids_sha256, decoded_sha256``.

Empty input gives empty output; NULL and empty texts do not pass the first
stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dashframe.llm import bpe, line_dedup, ngram_join, quality, winnow
from dashframe.llm.common import ship_package, stored, table

RANKS = "byte_bpe_multi_50k.tiktoken"
NEAR = ngram_join.Rule(words=5, num=4, den=5)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality.keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return ngram_join.one_per_class(docs, NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    ship_package(spark)
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    both = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    return both.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens",
                       *bpe.digests())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", tokens),
]

ORACLE_SQL = None   # the verdicts of the first two stages are not a matter of SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
