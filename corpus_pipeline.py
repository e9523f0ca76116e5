"""The corpus pipeline: each stage works on all rows its predecessor kept; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.llm import langid, mixing, neardup, packing, quality
from chorale.llm._common import free, materialize

#: Documents with a smaller share of letters in their main language go, as do those without a letter.
MIN_LANGUAGE_SHARE = 0.5
DUPLICATE_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with one main language."""
    model = langid.train(docs)
    name = free(docs, "_lang_found")
    found = docs.withColumn(name, langid.predict(docs, model))
    return found.filter((F.col(name)["lang_pred"] != "und") & (F.col(name)["score"] >= MIN_LANGUAGE_SHARE)).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and whose host isn't rejected. Null and blank texts fail; documents
    without a source are one host; repeated rows and null ids are judged row by row."""
    return quality.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies and of each id, that of the smallest id (of its rows, that of the least text);
    among rows without an id, one of each group. Rows with a null id and no words all stay."""
    return neardup.deduplicated(docs, percent=DUPLICATE_PERCENT)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, 0 to 2 times; rows that share an id, or have none, are mixed as rows of their own."""
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row's tokens, with its place in a sequence; a null or empty text is the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]
#: Tokens, a learned model and Newton's iterations can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
