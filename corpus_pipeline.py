"""Corpus pipeline: documents that are good, in a known language, not repeated and not part of a benchmark, packed.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
``documents``. Each result is written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellback.llm import decontaminate, language_id, ngram_join, packing, quality, util


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5 go. Learnt from the labelled documents that are not held out."""
    forest = quality.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, forest, name="_quality").where(F.col("_quality") >= 0.5).drop("_quality")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose likeliest language has a probability below 0.5, go."""
    model = language_id.fit(docs.where(~util.held_out("doc_id")))
    found = language_id.judged(docs, model, name="_language")
    return found.where((F.col("_language.lang") != language_id.UNKNOWN) & (F.col("_language.score") >= 0.5)).drop("_language")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of five-word shingles at a similarity of 0.75 form, the document with the smallest id stays.

    Rows that repeat an id and a text stay once. Rows with one id and different texts go together. Documents without an id stay.
    """
    groups = ngram_join.similar_groups(docs)
    gone = groups.where("doc_id != component_id").select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(gone, F.col("doc_id") == F.col("_id"), "left_anti")
    repeated = groups.groupBy("doc_id").agg(F.count("*").alias("_rows")).where("_rows > 1 and doc_id is not null").select(F.col("doc_id").alias("_id"))
    once = kept.join(repeated, F.col("doc_id") == F.col("_id"), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, F.col("doc_id") == F.col("_id"), "left_anti").unionByName(once)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name="_leaks")
    return found.where(F.size("_leaks") == 0).drop("_leaks")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, as pieces of sequences of at most 2048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Trees, alignments and packing are no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = util.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
