"""Documents to training ids in five stages, each written as Parquet and read back for the next.

A stage whose input is the written result of the one before begins by deleting what that one has stored on the way.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stockaudit.llm import arrowtext, language_zstd, pii_boosting, sentencepiece_agenda, string_tiling, weighted_minhash
from stockaudit.llm.queries import PIECE_MODEL, ship
from stockaudit.llm.tables import begin_chain, fresh_folder, read, reclaim


def _prepared(spark: SparkSession) -> None:
    """Workers have this package, and get texts in batches no larger than what they work on at once."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(arrowtext.SLICE_BYTES))


def told_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language compression tells apart."""
    begin_chain()
    _prepared(spark)
    return language_zstd.keep_identified(docs)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, that with the smallest ``doc_id``."""
    reclaim(docs)
    _prepared(spark)
    return weighted_minhash.one_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    reclaim(docs)
    _prepared(spark)
    return string_tiling.without(docs, read(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their personal data replaced by its kind, and ``n_chars`` that of the new text."""
    reclaim(docs)
    return pii_boosting.redact(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of each document's SentencePiece ids and of their decoded text."""
    reclaim(docs)
    _prepared(spark)
    return sentencepiece_agenda.digests(docs, public_tokenizers.path(PIECE_MODEL))


STAGES = [
    ("language identification", told_language),
    ("near duplicates", one_of_each_class),
    ("benchmark decontamination", clean_of_benchmark),
    ("personal data", redacted),
    ("sentencepiece encoding and decoding", piece_ids),
]

# No stage can be said in SQL; tests hold each against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each one keeps is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = fresh_folder(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
