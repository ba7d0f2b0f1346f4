"""From raw documents to packed sequences: each stage works on what the one before it wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.cluster import scratch_path
from tidemark.llm import language_id, line_dedup, ngram_jaccard, packing, substring_dedup
from tidemark.llm.language_id import remainder
from tidemark.llm.text import few, written

#: Tokens are not expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None

MIN_SCORE = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a posterior of ``MIN_SCORE`` or more; texts without a letter go."""
    model = language_id.train(docs.filter(remainder("doc_id", 3) != 1))
    names = docs.columns
    packed = docs.select(F.col("text").cast("string").alias("text"), F.struct(*names).alias("row"))
    told = language_id.predict(packed, model)
    return told.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*(F.col("row")[n].alias(n) for n in names))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier passage of three; those of which nothing is left go."""
    rest = [n for n in docs.columns if n not in ("doc_id", "text", "n_chars")]
    found = line_dedup.repeated_lines(docs, rest).filter("n_removed = 0 OR kept <> ''")
    return found.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(*docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of similar ones."""
    others = ngram_jaccard.similar_groups(docs).filter("component_id <> doc_id").select("doc_id")
    path = scratch_path(spark, "similar")
    others.write.parquet(path)
    return docs.join(few(spark.read.parquet(path)), "doc_id", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one holds; those of which nothing is left go, the others keep their text."""
    names, key = docs.columns, "doc_id"
    if not docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        key = "__row"  # ids repeat: rows get numbers of their own
        docs = written(docs.withColumn(key, F.monotonically_increasing_id()))
    cut = written(substring_dedup.repeated_passages(docs, row=key if key != "doc_id" else None).filter("n_removed > 0").select(key, "kept"))
    same = docs.join(few(cut.select(key)), key, "left_anti").select(*names)
    changed = docs.drop("text", "n_chars").join(cut.filter("kept <> ''").withColumn("text", F.col("kept")).withColumn(
        "n_chars", F.length("kept").cast("long")), key).select(*names)
    return same.unionByName(changed)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of at most 2048."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", keep_known_languages),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("substring dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; the others' results are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
