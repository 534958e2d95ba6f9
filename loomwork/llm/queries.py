"""The registered queries of this subpackage: thin, each applies one operator to its whole table.

All take empty tables, very long texts (read as a whole), ties and columns of any other name; see the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language, line_dedup, mixing, near_dedup, substring_dedup, suffix_dedup, toxicity, vector_dedup, warc
from .common import table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text: `und` for null texts and those without a letter. Repeated rows are scored alike."""
    return language.identify(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates at 0.8 over four-word shingles; null and blank texts and null ids are linked with nothing."""
    return near_dedup.groups(table(spark, sf_dir, "documents"), k=4)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling rates that give each language an equal share of the tokens; texts without words have the rate 1."""
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that a 50-byte string of a smaller doc_id covers go; null texts are empty, null ids lose nothing."""
    return suffix_dedup.repeats(table(spark, sf_dir, "documents")).drop("from_byte", "to_byte")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; null texts score as empty ones, repeated rows alike, without labels all low."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at a cosine of 0.9 within each dimension; null, empty, zero and non-finite vectors have none."""
    return vector_dedup.groups(table(spark, sf_dir, "embeddings"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside windows of benchmark items; null texts have no words, items without an id or a word no windows."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that three documents hold stay in the largest doc_id; null and empty texts are one empty line."""
    return line_dedup.line_digests(table(spark, sf_dir, "documents")).drop("keep_bitmap")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside runs of 35 that stand anywhere else go; every row is a text of its own, null texts have no words."""
    return substring_dedup.repeats(table(spark, sf_dir, "documents")).drop("from_word", "to_word")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records and back, one for each row, with or without a page_id; a null html is an empty payload."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """By name, all of them."""
    every = (
        op1_language, op2_near_dedup, op3_mixing, op4_suffix_dedup, op5_toxicity,
        op6_vector_dedup, op7_decontamination, op8_line_dedup, op9_substring_dedup, op10_warc,
    )
    return {f.__name__: f for f in every}
