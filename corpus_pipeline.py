"""The corpus pipeline: documents through the operators, one written table per stage.

Only ``doc_id`` and ``text`` are needed. All stages but the last return the columns
they are given, also those whose names their operators use; ``n_chars``, if there, is
kept up to date. The last one returns ``lang`` and ``source`` as null where they are
absent. Rows with a null or empty text fail the base rules; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bpe, decontam, neardup, quality, substring
from threadloom.llm.common import fresh
from threadloom.session import configure, staging_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove failing lines, then the documents that lose too much or fail the base rules."""
    configure(spark)
    return quality.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class, that of smallest doc_id."""
    configure(spark)
    return neardup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out passages that an earlier document holds; documents left without a word go."""
    configure(spark)
    own = {c: fresh(docs, f"_own_{c}") for c in docs.columns if c.lower() in ("n_words", "n_removed")}
    kept = substring.remove_repeats(docs.withColumnsRenamed(own))
    kept = kept.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    if "n_chars" in docs.columns:
        new = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text"))
        kept = kept.withColumn("n_chars", new.cast("bigint"))
    return kept.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that contain a benchmark item."""
    configure(spark)
    return decontam.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a check that they decode to its text."""
    configure(spark)
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    absent = {c: F.lit(None).cast("string") for c in ("lang", "source") if c not in docs.columns}
    labelled = docs.withColumns({**absent, "text_sha256": F.sha2(F.coalesce("text", F.lit("")), 256)})
    keys = ["doc_id", "lang", "source", "text_sha256"]
    encoded = bpe.encode(labelled, vocabulary, public_tokenizers.PATTERN, keys=keys)
    both = bpe.decode(encoded.withColumn("_ids", F.col("token_ids")), vocabulary, ids="_ids")
    return both.select(
        "doc_id", "lang", "source", "n_tokens", "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "text_sha256",
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_items", benchmark_items),
    ("tokens", tokens),
]

# Tokens and components are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    home = staging_path(configure(spark), "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{home}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
