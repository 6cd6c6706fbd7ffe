"""The training-text pipeline: five stages over documents, each written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunplane.llm.decontaminate import drop_leaks
from sunplane.llm.line_dedup import dedup_lines
from sunplane.llm.ngram_join import drop_near
from sunplane.llm.packing import pack_documents
from sunplane.llm.quality_rules import apply_rules
from sunplane.staging import staged


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars counted anew where there is one."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the others lose the lines that too many documents of their source share. Exact copies
    count as one document here: the third stage keeps one of them, so they mustn't reject each other."""
    return _recounted(apply_rules(docs, copies_count=False), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated three-line windows go; so do documents that have no line left."""
    return _recounted(dedup_lines(docs).filter("n_removed = 0 or text <> ''"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id."""
    return drop_near(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document, with their token ids."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: DuckDB can't state MinHash groups or token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
