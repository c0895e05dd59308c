"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

Columns besides doc_id, text, lang, source and n_chars are passed on, whatever their names. An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm.common import word_count
from sessionlens.llm.decontaminate import decontaminate
from sessionlens.llm.jaccard_join import keep_one_of_each
from sessionlens.llm.language_id import keep_identified
from sessionlens.llm.line_dedup import line_dedup
from sessionlens.llm.mixing import take_mix
from sessionlens.sources.sinks import drop_staged, only_kept, staged


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null and empty texts and texts without letters can't. Repeated rows go alike, null ids like others."""
    return keep_identified(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; documents that were nothing else are gone.

    ``n_chars``, where there is such a column, follows a text that was cut. Null and empty texts stay; repeated rows are one document.
    """
    kept = line_dedup(docs, report=True)
    kept = kept.where((F.col("lines_cut") == 0) | (word_count(F.col("text")) > 0))
    if "n_chars" in docs.columns:
        length = F.when(F.col("lines_cut") == 0, F.col("n_chars")).otherwise(F.length("text"))
        kept = kept.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id (null last); texts without words all stay."""
    return keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without items of the benchmark of five words or more; null and empty texts contain nothing."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of copies; those without words, null and empty texts are never taken. Null is a source."""
    return take_mix(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

ORACLE_SQL = None  # language models and random draws are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what the stages staged is deleted as soon as the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        with only_kept(spark) as keep:
            docs = staged(stage(spark, docs, sf_dir))
            keep.append(docs)
        if before is not None:
            drop_staged(before)
        before = docs
    return docs
