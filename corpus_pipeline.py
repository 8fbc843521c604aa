"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Language identification drops what no language explains; exact duplicates leave the row with the largest id, near
duplicates the document that names its component; documents that overlap with a test item go; the rest is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatherline.llm.common import written
from gatherline.llm.decontam import without_overlap
from gatherline.llm.exact_dedup import without_duplicates
from gatherline.llm.jaccard_join import one_of_each
from gatherline.llm.langid import in_known_language
from gatherline.llm.packing import pack_documents
from gatherline.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_known_language(spark, docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_duplicates(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(spark, docs, n=5, share=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_overlap(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(spark, docs, tokenizer_path())


STAGES = [("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: The language models and the packing plan are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return docs
