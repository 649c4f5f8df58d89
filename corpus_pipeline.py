"""From raw documents to packed training sequences: five stages over the whole table.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the columns of
documents (the last one: the packed pieces). An empty table gives an empty result; columns besides those of documents are
kept up to the last stage, whatever their names. A stage begins by removing the intermediate tables of the stages before,
whose results are stored by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinloom.llm import crf_langid, fair_mix, parity_join, risk_rules
from kinloom.llm.common import cut, new_path, table, tidy
from kinloom.llm.queries import pack_documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any language, or with a label that a confident prediction contradicts, go."""
    return crf_langid.keep_identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a certified cutoff go."""
    tidy(spark, docs)
    return risk_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    tidy(spark, docs)
    return parity_join.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights; a document that the mix takes twice comes twice."""
    tidy(spark, docs)
    return fair_mix.mix(docs, lambda df: cut(df, "mix"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place."""
    tidy(spark, docs)
    return pack_documents(docs)


STAGES = [
    ("language ID", language),
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packing),
]

#: The language and packing stages can't be expressed in SQL; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    for i, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{i}")
        out = stage(spark, docs, sf_dir)
        (out.select(*columns) if i < len(STAGES) - 1 else out).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
