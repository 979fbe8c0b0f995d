"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, htmltext, lm, prefixtrie, quality, sharding, simhash, snapshots, topk, toxicity, whitening, wordbpe
from plumbline.llm.common import remainder, table, written


def op1_quality_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = quality.feature_table(table(spark, sf_dir, "documents"), spark)
    model = quality.learn_from(features, table(spark, sf_dir, "labels"), spark, quality.train_rows(5, 0))
    found = quality.table_scores(features, model, spark)
    held_out = remainder(F.col("doc_id"), 5) == 0
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.learn_grammar(docs, table(spark, sf_dir, "labels"), spark, toxicity.train_rows(3, 1))
    found = toxicity.scores(docs, grammar, spark)
    held_out = remainder(F.col("doc_id"), 3) == 1
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), *toxicity.CHANNELS)


def op3_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 10) == 0
    found = lm.language_model_scores(table(spark, sf_dir, "documents"), spark, ~held_out, min_count=1)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), spark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), spark)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op7_snapshot_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return snapshots.render(conversations, snapshots.maximal(written(snapshots.prefixes(conversations), spark)))


def op8_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(table(spark, sf_dir, "documents"), spark)
    law = [F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")]
    return found.select("doc_id", "size", "text_crc32", *law)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), spark)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.encode_table(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_table(table(spark, sf_dir, "embeddings"), spark)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"), spark)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_nnpu": op1_quality_nnpu,
    "op2_toxicity_grammar": op2_toxicity_grammar,
    "op3_elias_fano_lm": op3_elias_fano_lm,
    "op4_decontaminate": op4_decontaminate,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_text_density": op6_text_density,
    "op7_snapshot_chats": op7_snapshot_chats,
    "op8_bounded_ring": op8_bounded_ring,
    "op9_exact_topk": op9_exact_topk,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_word_bpe": op11_word_bpe,
    "op12_whitening": op12_whitening,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {
    "op7_snapshot_chats": snapshots.ORACLE,
    "op9_exact_topk": topk.ORACLE,
    "op13_prefix_trie": prefixtrie.ORACLE,
}
