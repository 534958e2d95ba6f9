"""Corpus pipeline: toxicity, line dedup, near-duplicates, benchmark decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from loomwork.llm.common import discard, spill, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go.

    A null text scores as an empty one, repeated rows score alike, rows without a doc_id are judged like others; a long
    text is read as a whole. Without labels nothing is rejected.
    """
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 code points or more that three documents hold stay only in the largest doc_id. No row goes.

    Null and empty texts stay as they are; a text that loses all lines becomes empty. Rows without a doc_id lose nothing,
    rows that share one are one document.
    """
    return line_dedup.drop_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, 0.8) the smallest doc_id stays, with all rows that repeat it.

    Rows without a doc_id or without a word are copies of nothing and stay.
    """
    return near_dedup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go, or with all words of a shorter item.

    Null and blank texts stay; rows without a doc_id are judged like others, repeated rows each by itself.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def set_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with the rate (mix_rate) at which sampling meets equal token shares of the languages.

    Null and blank texts have the rate 1; rows without a lang teach nothing and are rated by their words; rows that
    repeat a doc_id and text have one rate.
    """
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", set_rates),
]

#: The first and the last stage are fitted models, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's table goes when the next one
    is written."""
    docs, past = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = spill(stage(spark, docs, sf_dir), f"pipeline-{name}", "snappy")
        if past is not None:
            discard(past)
        past = docs
    return docs
