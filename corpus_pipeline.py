"""A training-data pipeline over ``documents``: quality, copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``docs``. The stages need no numbering of rows: repeated
ids, NULLs and extra columns pass as each operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabwright.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from tabwright.llm.queries import ARROW_ROWS, CAPACITY, tokenizer_path
from tabwright.session import stage


def _whole_texts(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    _whole_texts(spark)
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with similarity 0.8 or more."""
    _whole_texts(spark)
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    _whole_texts(spark)
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of at most 2048 tokens."""
    _whole_texts(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), 0, CAPACITY)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near),
          ("mixing sources", mix), ("best-fit packing", pack)]

#: SQL can express neither the fitted rules nor the draws of the mixture nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is a written table."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, "documents")
    return docs
