"""One registered query per operator of this package, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likerec.llm import (bpe, centroids, decontamination, filteraudit, linededup, mixing, quality, repeats, sharding, simhash, tokencounts,
                         toxicity, vectors)
from likerec.llm.common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _splitting_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    marked = simhash.near_duplicates(table(spark, folder, "documents"), words=3, max_distance=3)
    return marked.select("doc_id", "fingerprint", "component_id")


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = linededup.drop_shared_lines(table(spark, folder, "documents"), min_documents=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"), temperature=0.5, epochs=1.0, seed=20)


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = tokencounts.count_tokens(table(spark, folder, "documents"), _vocabulary("byte_bpe_50k.json"), limit=512)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = (_vocabulary("byte_bpe_50k.tiktoken"), _splitting_pattern())
    encoded = bpe.encode_texts(table(spark, folder, "documents"), *vocabulary).select("doc_id", "n_tokens", "ids")
    decoded = bpe.decode_ids(encoded, vocabulary[0])
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    linked = vectors.near_vectors(table(spark, folder, "embeddings"), threshold=0.95)
    return linked.select("vec_id", "n_links", "component_id", "kept")


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.base_rules(table(spark, folder, "documents"), min_words=10, max_repeat_percent=20)
    kept = quality.with_host_verdicts(judged.drop("text"), host="source", max_rate=0.5)
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit_from_labels(docs, table(spark, folder, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op9_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, folder, "documents"), width=400)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    dealt = sharding.shuffle_into_shards(table(spark, folder, "documents"), shards=16, seed=20)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filteraudit.audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels")).select(
        "part", "filter_order", "step", *filteraudit.STEPS)


def op12_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return centroids.cluster_vectors(vectors, clusters=8, rounds=10, size=64, scale=1024, seed="3")


def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.find_benchmark_words(docs, table(spark, folder, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
