"""Corpus pipeline: documents to packed training sequences.

Quality rules, line dedup, near-duplicate removal, secret redaction and best-fit
packing, each over everything its predecessor kept. Between stages the documents
are written as Parquet to the shared checkpoint folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrilens.llm import common, line_dedup, packing, quality_rules, secret_scan, simhash_dedup


#: Most bytes of the rows that a task hands to Python at once.
BATCH_BYTES = "16m"


def _small_batches(docs: DataFrame) -> DataFrame:
    """docs; tasks of the session hand rows to Python in small batches, as one executor runs all stages one after the other."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return docs


def _resized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, with n_chars following the text."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else docs[c] for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.filter_documents(_small_batches(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those with no line left go."""
    found = line_dedup.dedup_lines(docs).where(F.col("text").rlike(r"\S"))
    return _resized(found, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8 or more."""
    return simhash_dedup.keep_one(_small_batches(docs), width=5, similarity=0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark."""
    return _resized(secret_scan.redact(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences."""
    return packing.pack_documents(_small_batches(docs))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-duplicates", near_duplicates), ("secret scans", secrets), ("packing", packed)]

#: Token measures, fingerprints and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.stored(docs)
    return docs
