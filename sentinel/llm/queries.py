"""Registered queries of this package; each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinel.llm import chat, pieces, toxicity
from sentinel.llm.divergence import divergence
from sentinel.llm.embedding_dedup import near_vectors
from sentinel.llm.fingerprint import fingerprint, likeness, with_next
from sentinel.llm.ngram_join import jaccard_groups
from sentinel.llm.prefix_trie import end_digests, prefix_trie
from sentinel.llm.sharding import shard
from sentinel.llm.source_mix import mixed
from sentinel.llm.substring_dedup import remove_repeats
from sentinel.llm.topk import top_k
from sentinel.llm.url_filter import judge

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
SHARDS = 40
ESCAPED_EXAMPLE = "\\### Assistant: </turn> ok"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(_table(spark, folder, "embeddings"), "vec_id % 20 = 0", k=20, scale=64)


def op2_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    example = spark.createDataFrame([(-7, 0, "user", ESCAPED_EXAMPLE), (-7, 1, "assistant", ESCAPED_EXAMPLE)],
                                    "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_turns(turns.union(example)))


def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return judge(_table(spark, folder, "pages").select("page_id", "url"), URL_RULES)


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, and the digest of the text that decoding them gives."""
    vocabulary = pieces.Vocabulary.load()
    tokens = pieces.encode(_table(spark, folder, "documents").select("doc_id", "text"), vocabulary).drop("text")
    texts = pieces.decode(tokens, vocabulary)
    ids = F.sha2(F.array_join("token_ids", ","), 256)
    return texts.select("doc_id", F.coalesce(F.size("token_ids"), F.lit(0)).cast("bigint").alias("n_tokens"),
                        ids.alias("ids_sha256"), F.sha2("text", 256).alias("text_sha256"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.learn(docs, _table(spark, folder, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixed(_table(spark, folder, "documents"), weights=(3, 1, 2), share=1.5, most=2)
    return plan.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken")


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = shard(_table(spark, folder, "documents").select("doc_id", "text"), SHARDS)
    return placed.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"),
                         "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_table(spark, folder, "embeddings"), threshold=0.98)


def op9_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_groups(_table(spark, folder, "documents").select("doc_id", "text"), width=3, num=90, den=100)


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_repeats(_table(spark, folder, "documents").select("doc_id", "text"))
    spaced = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    digest = F.sha2(spaced, 256)
    return kept.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    nodes, ends = prefix_trie(_table(spark, folder, "conversations"), donor="conv_id - conv_id % 20",
                              head="crc32(cast(cast(conv_id AS string) AS binary)) % 4", most=3)
    digests = end_digests(ends).withColumnRenamed("node", "end")
    numbers = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return nodes.join(digests, nodes.node == digests.end, "left").select(
        *numbers, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence(_table(spark, folder, "documents"))


def op13_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """A document, and an edited one whose last third is the beginning of the next document."""
    docs = with_next(_table(spark, folder, "documents").select("doc_id", "text"))
    kept = F.expr("left(text, length(text) - length(text) div 3)")
    edited = docs.withColumn("edited", F.concat(kept, "next_start")).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return edited.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                         "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                         likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), "next_id")


QUERIES = {f.__name__: f for f in (
    op1_exact_top_k, op2_chat_formatting, op3_url_filters, op4_sentencepiece, op5_toxicity, op6_source_mix, op7_sharding,
    op8_embedding_dedup, op9_ngram_jaccard_join, op10_substring_dedup, op11_prefix_trie, op12_source_divergence,
    op13_document_fingerprints)}
