"""Ranking metrics, one implementation with an explicit depth and an explicit list of cut-offs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def first_ranks(ranked: DataFrame, expected: DataFrame, depth: int | None, caseless: bool = True) -> DataFrame:
    """(query_id, first_rank): the rank from 1 of the first relevant row within depth, null if there is none.

    ranked: (query_id, rank, name); expected: (query_id, expected), one row a query. Names compare trimmed and
    caseless, or as they are. Every query of `expected` is there, with no hit too.
    """
    norm = (lambda c: tx.fold(tx.trim(F.col(c).cast("string")))) if caseless else F.col
    seen = ranked if depth is None else ranked.where(F.col("rank") <= depth)
    hits = seen.join(expected, "query_id").where(norm("name") == norm("expected")).groupBy("query_id").agg(
        F.min("rank").alias("first_rank")
    )
    return expected.select("query_id").join(hits, "query_id", "left")


def summary(ranks: DataFrame, ks: list[int] | tuple[int, ...] = (1, 3, 5, 10), digits: int = 6) -> DataFrame:
    """One row: n_queries, misses, hit_at_<k>, mrr, mean_first_rank (null without hits). Misses count 0; no query at
    all gives zeros."""
    r = F.col("first_rank")
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), digits)
    hit = [mean(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"hit_at_{k}") for k in ks]
    return ranks.agg(
        F.count("*").alias("n_queries"),
        F.count_if(r.isNull()).alias("misses"),
        *hit,
        mean(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"),
        F.round(F.avg(r), digits).alias("mean_first_rank"),
    )


def at_ks(ranks: DataFrame, ks: list[int], digits: int = 6) -> DataFrame:
    """(k, hits, hit_rate, mrr_at_k, ndcg_at_k) for each distinct positive k; one relevant row, so the gain is
    1 / log2(rank + 1). The cross side is the list of cut-offs."""
    cuts = ranks.sparkSession.createDataFrame([(k,) for k in sorted({k for k in ks if k > 0})], "k int")
    r = F.when(F.col("first_rank") <= F.col("k"), F.col("first_rank"))
    got = ranks.join(F.broadcast(cuts)).groupBy("k").agg(
        F.count(r).alias("hits"),
        F.avg(F.when(r.isNull(), 0.0).otherwise(1.0)).alias("hit_rate"),
        F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr_at_k"),
        F.avg(F.coalesce(1.0 / F.log2(r + 1), F.lit(0.0))).alias("ndcg_at_k"),
    )
    zero = cuts.join(got, "k", "left")
    return zero.select(
        "k",
        F.coalesce("hits", F.lit(0)).alias("hits"),
        *(F.round(F.coalesce(c, F.lit(0.0)), digits).alias(c) for c in ("hit_rate", "mrr_at_k", "ndcg_at_k")),
    )


def flatten(metrics: DataFrame, field: str, model: str) -> DataFrame:
    """Tall rows (metric, value) named eval/<field>/<model>/<metric>."""
    names = [c for c in metrics.columns]
    tall = metrics.select(
        F.explode(
            F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(c).cast("double") for c in names)))
        ).alias("m", "value"),
    )
    return tall.select(F.concat(F.lit(f"eval/{field}/{model}/"), "m").alias("metric"), "value")


def nested(tall: DataFrame) -> DataFrame:
    """One row (json) of metrics of flatten(): objects of fields, of models in them, of metrics in those."""
    parts = tall.select(F.split("metric", "/").alias("p"), "value").select(
        F.get("p", 1).alias("field"), F.get("p", 2).alias("model"), F.get("p", 3).alias("m"), "value"
    )

    def packed(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
        by_name = lambda a, b: F.when(a[name] < b[name], -1).otherwise(1)
        return df.groupBy(*keys).agg(
            F.map_from_entries(
                F.array_sort(F.collect_list(F.struct(name, F.col(value).alias("of"))), by_name)
            ).alias("v"),
        )

    models = packed(parts, ["field", "model"], "m", "value")
    fields = packed(models, ["field"], "model", "v")
    return packed(fields, [], "field", "v").select(F.to_json("v").alias("json"))


def from_callback(pairs: DataFrame, retrieve, ks: list[int]) -> DataFrame:
    """(query_id, rank, name) rows from a function retrieve(query, top_k) -> names, called once a query on the executors."""
    import pandas as pd

    most = max(ks)

    def run(batches):
        for pdf in batches:
            rows = [
                (q, i + 1, n) for q,
                text in zip(pdf.query_id, pdf["query"], strict=True) for i,
                n in enumerate(retrieve(text, most))
            ]
            yield pd.DataFrame(rows, columns=["query_id", "rank", "name"])

    return pairs.select("query_id", "query").mapInPandas(run, "query_id long, rank int, name string")
