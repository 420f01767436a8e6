"""The operators' queries over the synthetic tables, with production parameters, and their SQL."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphaudit.llm import ann, bpe, centroids, jaccard, language, lines, merkle, packing, phrases, repeats, sharding, suffixes, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    return os.fspath(public_tokenizers.path("word_bpe_49k.json"))


def op1_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.predicted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), language.train(docs))
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), vocabulary()))


def op3_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(merkle.fingerprints(table(spark, sf_dir, "documents")))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(table(spark, sf_dir, "documents")))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.remove_passages(table(spark, sf_dir, "documents")))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.drop_lines(table(spark, sf_dir, "documents")))


QUERIES = {"op1_bigru": op1_bigru, "op2_packing": op2_packing, "op3_zstd_toxicity": op3_zstd_toxicity, "op4_hash_tree": op4_hash_tree, "op5_posting_lists": op5_posting_lists, "op6_jaccard": op6_jaccard, "op7_merkle": op7_merkle, "op8_bpe": op8_bpe, "op9_repeats": op9_repeats, "op10_suffixes": op10_suffixes, "op11_centroids": op11_centroids, "op12_phrases": op12_phrases, "op13_lines": op13_lines}
SQL = {"op4_hash_tree": sharding.sql(), "op7_merkle": merkle.sql(), "op11_centroids": centroids.sql(), "op12_phrases": phrases.sql(), "op13_lines": lines.sql()}
