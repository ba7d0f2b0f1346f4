"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.cluster import scratch_path
from tidemark.llm import (
    embedding_dedup,
    language_id,
    line_dedup,
    merkle_manifest,
    ngram_jaccard,
    packing,
    phrase_mining,
    prefix_forest,
    quality_classifier,
    quality_rules,
    sentencepiece_scan,
    substring_dedup,
    token_counts,
)
from tidemark.llm.language_id import remainder

BYTE_BPE = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learnt from labelled rows that are not held out."""
    path = scratch_path(spark, "figures")
    quality_classifier.describe(_table(spark, sf_dir, "documents")).write.parquet(path)
    figures = spark.read.parquet(path)
    labels = _table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    ensemble = quality_classifier.fit(figures, labels)
    return figures.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), ensemble.score().alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.3).cast("int"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many of them repeat an earlier passage, and the digest of the rest."""
    found = line_dedup.repeated_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of the cascade for every document."""
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 4-word shingle sets are similar by 0.85 or more."""
    return ngram_jaccard.similar_groups(_table(spark, sf_dir, "documents"), 4, 85, 100)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, how many lie in a passage of 13 words of an earlier document, and the digest of the rest."""
    found = substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"), 13)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from rows that are not held out."""
    documents = _table(spark, sf_dir, "documents")
    model = language_id.train(documents.filter(remainder("doc_id", 3) != 1))
    found = language_id.predict(documents.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, a digest of their ids, and whether they decode to its text."""
    return sentencepiece_scan.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, group and verdict of every vector."""
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), 0.95)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy pieces of every document."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 2048."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), 2048)


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of each language whose words keep company most."""
    return phrase_mining.phrases(_table(spark, sf_dir, "documents"), 100, 5, 2000)


def op12_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return prefix_forest.nearest(_table(spark, sf_dir, "embeddings"), 20, 20)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and witness of every document, and whether the witness still holds where line ends were deleted from half of them."""
    documents = _table(spark, sf_dir, "documents").select(*merkle_manifest.FIELDS)
    cut = merkle_manifest.leaf_digest(text=F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit("")))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = merkle_manifest.manifest(documents.withColumn("tampered", F.when(chosen, cut)), ["tampered"])
    found = merkle_manifest.folded(rows.withColumn("shown", F.coalesce("tampered", "leaf")), "shown", "folded_root")
    digests = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "folded_root")]
    return found.select("doc_id", *digests, F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_line_dedup, op3_quality_rules, op4_ngram_jaccard, op5_substring_dedup, op6_language_id,
                                   op7_sentencepiece, op8_embedding_dedup, op9_token_counts, op10_packing, op11_phrase_mining,
                                   op12_prefix_forest, op13_merkle_manifest)}
ORACLES = {"op2_line_dedup": line_dedup.ORACLE, "op3_quality_rules": quality_rules.ORACLE, "op11_phrase_mining": phrase_mining.ORACLE,
           "op13_merkle_manifest": merkle_manifest.ORACLE}
