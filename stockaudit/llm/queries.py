"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stockaudit.llm import (
    html_regions,
    language_zstd,
    line_dedup,
    masked_lm,
    merkle_manifest,
    pii_boosting,
    prefix_forest,
    rans_tokens,
    sentencepiece_agenda,
    spelling_bloom,
    string_tiling,
    url_boosting,
    weighted_minhash,
)
from stockaudit.llm.tables import read

Query = Callable[[SparkSession, str], DataFrame]

PIECE_MODEL = "piece_bpe_32k.model"
WORD_TOKENIZER = "word_bpe_49k.json"
END_ID = 2
NEIGHBOURS = 20
QUERY_STEP = 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for Python workers that lack it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="stockaudit-code-")) / "stockaudit.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_agenda.digests(read(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def masked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return masked_lm.score_words(docs, masked_lm.learn(docs))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.assigned(read(spark, sf_dir, "documents"))


def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = string_tiling.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "tiles", "covered", "item_words", "coverage")


def rans_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans_tokens.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), END_ID)


def language_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_zstd.identify(read(spark, sf_dir, "documents"))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_boosting.judge(read(spark, sf_dir, "pages"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_boosting.digests(read(spark, sf_dir, "documents"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_regions.main_texts(read(spark, sf_dir, "pages"))


def hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return prefix_forest.search(rows, rows.where(F.pmod("vec_id", F.lit(QUERY_STEP)) == 0), NEIGHBOURS)


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(read(spark, sf_dir, "documents"))


def merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.digests(read(spark, sf_dir, "documents"))


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_bloom.variants(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_sentencepiece_agenda": sentencepiece_codec,
    "op2_masked_lm": masked_scores,
    "op3_weighted_minhash": near_duplicates,
    "op4_string_tiling": benchmark_overlap,
    "op5_rans_tokens": rans_output,
    "op6_url_boosting": url_filter,
    "op7_language_zstd": language_compression,
    "op8_pii_boosting": personal_data,
    "op9_html_regions": html_text,
    "op10_prefix_forest": hash_prefix_forest,
    "op11_line_dedup": repeated_lines,
    "op12_merkle_manifest": merkle_proofs,
    "op13_spelling_bloom": spelling_variants,
}

SQL = {
    "op11_line_dedup": line_dedup.SQL,
    "op12_merkle_manifest": merkle_manifest.SQL,
    "op13_spelling_bloom": spelling_bloom.SQL,
}


def queries() -> dict[str, Query]:
    def shipped(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return query(spark, sf_dir)

        return run

    return {name: shipped(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express; tests hold the others against plain versions."""
    return dict(SQL)
