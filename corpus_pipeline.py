"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but
the last return the columns of ``documents``. Nulls count as empty texts, repeated ids are
rows of their own, empty tables pass through, and extra columns are carried along untouched.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quietlake.llm import quality as quality_model
from quietlake.llm.common import read_table, with_rows, without_rows, written
from quietlake.llm.exact_dedup import exact_dedup
from quietlake.llm.jaccard_join import jaccard_components
from quietlake.llm.packing import pack_documents
from quietlake.llm.secret_scan import redact
from quietlake.llm.word_tokens import read_model
from quietlake.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.5 or more)."""
    return quality_model.accepted(docs, quality_model.train(docs, read_table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id."""
    ship(spark)
    numbered, row = with_rows(docs)
    return without_rows(numbered, row, exact_dedup(numbered, row_col=row).filter("not kept").selectExpr(f"row as {row}"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of five-word shingles, the one with the smallest id."""
    ship(spark)
    numbered, row = with_rows(docs)
    return without_rows(numbered, row, jaccard_components(numbered, row_col=row).filter("not first").selectExpr(f"row as {row}"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    ship(spark)
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 2048 ids."""
    ship(spark)
    return pack_documents(docs, read_model(public_tokenizers.path("word_bpe_49k.json"))).drop("ids")


STAGES = [("quality", quality), ("exact_dedup", exact), ("jaccard_join", near), ("secret_scan", secrets), ("packing", packing)]
#: SQL can't express the classifier's and the packing's stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
