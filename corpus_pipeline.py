"""The corpus pipeline: documents in, token sequences of the clean, deduplicated and mixed corpus out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinel.llm import pieces, toxicity
from sentinel.llm.ngram_join import jaccard_groups, keep_first
from sentinel.llm.source_mix import apply_mix, mixed
from sentinel.llm.substring_dedup import remove_repeats
from sentinel.session import materialize


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, taught by the labels, finds toxic go; held-out labels are never learned."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    return scored.where("predicted = 0").select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8 or more."""
    return keep_first(docs, jaccard_groups(docs, width=5, num=80, den=100)).select(docs.columns)


def _counted(docs: DataFrame) -> DataFrame:
    """`n_chars` follows a changed text."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id also has go."""
    return _counted(remove_repeats(docs)).select(docs.columns)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes once for each pass that takes words of it."""
    return _counted(apply_mix(docs, mixed(docs))).select(docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the whole texts."""
    tokens = pieces.encode(docs.select("doc_id", "source", "text"), pieces.Vocabulary.load())
    return tokens.select("doc_id", "source", "token_ids", F.coalesce(F.size("token_ids"), F.lit(0)).cast("bigint").alias("n_tokens"))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("substring_dedup", without_repeats),
    ("source_mix", to_target_weights),
    ("sentencepiece", to_tokens),
]

#: The learned grammar, signature search and piece search have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
