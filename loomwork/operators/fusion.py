"""Reciprocal-rank fusion of ranked lists of (query_id, doc_id, rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ordinals import numbered


def rank_positions(scores: DataFrame, query: str = "query_id", doc: str = "doc_id", score: str = "score") -> DataFrame:
    """Places from 0, score descending, then document ascending, of lists of any length: all lists are sorted as one over
    range partitions, and a list's places count from its first row."""
    placed = numbered(scores, [query, F.desc(score), doc], "all__")
    first = placed.groupBy(F.col(query).alias("q__")).agg(F.min("all__").alias("first__"))
    both = placed.join(first, F.col(query) == F.col("q__"))
    return both.withColumn("position", F.col("all__") - F.col("first__")).drop("all__", "q__", "first__")


def merge(
    dense: DataFrame,
    sparse: DataFrame,
    limit: int | None = None,
    k: int = 60,
    weights: tuple[float, float] = (1.0, 1.0),
    digits: int = 9,
) -> DataFrame:
    """(query_id, doc_id, rrf_score, dense_rank, sparse_rank, rank): the sum of weight / (k + rank), 0 for a missing side.

    Ties: the better dense rank, then the better sparse rank. A union and one aggregation, so that each list is
    shuffled once.
    """
    mark = lambda df, side: df.select(
        "query_id",
        "doc_id",
        *(
            F.col("rank").cast("long").alias(s) if s == side else F.lit(None).cast("long").alias(s) for s in ("dense_rank", "sparse_rank")
        ),
    )
    both = mark(dense, "dense_rank").unionByName(mark(sparse, "sparse_rank")).groupBy("query_id", "doc_id").agg(
        F.max("dense_rank").alias("dense_rank"), F.max("sparse_rank").alias("sparse_rank")
    )
    part = lambda c, w: F.coalesce(F.lit(w) / (k + F.col(c)), F.lit(0.0))
    scored = both.withColumn(
        "rrf_score", F.round(part("dense_rank", weights[0]) + part("sparse_rank", weights[1]), digits)
    )
    order = [F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), "doc_id"]
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))
    return out if limit is None else out.where(F.col("rank") <= limit)


def merge_with_texts(dense: DataFrame, sparse: DataFrame, columns: list[str], limit: int, k: int = 60) -> DataFrame:
    """The merge with scores and document columns of both sides, those of the dense side first."""
    fused = merge(dense, sparse, limit, k)
    d = dense.select(
        "query_id", "doc_id", F.col("score").alias("semantic_score"), *(F.col(c).alias(f"d_{c}") for c in columns)
    )
    s = sparse.select(
        "query_id", "doc_id", F.col("score").alias("sparse_score"), *(F.col(c).alias(f"s_{c}") for c in columns)
    )
    out = fused.join(d, ["query_id", "doc_id"], "left").join(s, ["query_id", "doc_id"], "left")
    return out.select(
        "query_id",
        "doc_id",
        "rrf_score",
        "semantic_score",
        "sparse_score",
        *(F.coalesce(f"d_{c}", f"s_{c}").alias(c) for c in columns),
        "rank",
    )


def weighted_neighbours(
    dense: DataFrame,
    sparse: DataFrame,
    exclude: DataFrame,
    limit: int,
    weights: tuple[float, float] = (1.0, 1.0),
    k: int = 60,
) -> DataFrame:
    """Fusion in which excluded (query_id, doc_id) pairs contribute nothing but still hold their places in the lists."""
    keep = lambda df: df.join(exclude, ["query_id", "doc_id"], "left_anti")
    return merge(keep(dense), keep(sparse), limit, k, weights)
