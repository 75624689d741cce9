"""The corpus pipeline: five stages over documents, each written as Parquet and reread by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import bpe, decontamination, language, paragraphs, superminhash
from corpuscle.llm._spark import Tables
from corpuscle.llm.queries import tokenizer
from corpuscle.plans.ship import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; goes: no letter at all, or a score below 0.35."""
    return language.accepted(docs, least_score=0.35)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each near-duplicate component (five words, 0.8)."""
    gone = superminhash.near_duplicates(docs, n=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages from texts, with n_chars brought up to date; goes: a document of which no word is left."""
    cut = paragraphs.deduplicated(docs, percent=80, n=5).where(r"n_removed_words = 0 or text rlike '[^\\x09-\\x0D ]'")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed_words") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return cut.select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no passage of the benchmark."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every document that is left."""
    return bpe.encode(docs, tokenizer("word_bpe_49k.json")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


def _with_code(stage: Callable) -> Callable:
    return lambda spark, docs, sf_dir: stage(ship(spark), docs, sf_dir)


STAGES = [
    ("language_id", _with_code(language_id)),
    ("near_dedup", _with_code(near_dedup)),
    ("substring_dedup", _with_code(substring_dedup)),
    ("benchmark_decontamination", _with_code(benchmark_decontamination)),
    ("bpe_encoding", _with_code(bpe_encoding)),
]

#: SQL has no words for the learned, hashed and aligned stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, one written table after the other."""
    tables, docs = Tables(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = tables.write(stage(spark, docs, sf_dir), name)
    return docs
