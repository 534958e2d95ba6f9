"""BM25 (Okapi) ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, written

K1, B, EPSILON = 1.5, 0.75, 0.25
#: The terms of all queries are broadcast while they take no more bytes than this; beyond, the joins shuffle.
BROADCAST_BYTES = 48 << 20


def tokens(df: DataFrame, key: str, tokenized: Column) -> DataFrame:
    """(key, toks): the terms of each row."""
    return df.select(F.col(key), tokenized.alias("toks"))


def postings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, tok, tf) of (key, toks) rows."""
    return docs.select(key, F.explode("toks").alias("tok")).groupBy(key, "tok").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n_docs (empty ones too) and their mean length."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size("toks")).alias("avg_len"))


def idf(docs: DataFrame) -> DataFrame:
    """(tok, df, idf) of every term. A term in over half of the documents would have a negative idf; it gets EPSILON
    times the mean of all raw values instead."""
    df = docs.select(F.explode(F.array_distinct("toks")).alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    raw = df.join(F.broadcast(n)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_raw"))  # one row
    return raw.join(F.broadcast(mean)).select(
        "tok", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_raw")).otherwise(F.col("raw")).alias("idf")
    )


def score(docs: DataFrame, queries: DataFrame, doc_key: str = "doc_id", query_key: str = "query_id") -> DataFrame:
    """(query, doc, score) of every pair that shares a term; docs and queries are (key, toks) rows.

    Only postings of query terms leave the scan: the exploded terms meet the query vocabulary in a broadcast join
    (its size is checked) before any shuffle. A term that a query repeats counts as often.
    """
    asked = queries.select(
        query_key, F.explode("toks").alias("tok")
    ).groupBy(query_key, "tok").agg(F.count("*").alias("qn"))
    vocabulary = asked.select("tok").distinct()
    room = asked.agg(F.sum(F.octet_length("tok") + 64)).first()[0] or 0
    hint = F.broadcast if room <= BROADCAST_BYTES else lambda x: x
    weights = idf(docs).join(hint(vocabulary), "tok", "left_semi").select("tok", "idf")
    stats = corpus_stats(docs)
    hit = docs.select(
        doc_key, F.size("toks").alias("len"), F.explode("toks").alias("tok")
    ).join(hint(vocabulary), "tok", "left_semi").groupBy(doc_key, "len", "tok").agg(F.count("*").alias("tf"))
    part = hit.join(hint(weights), "tok").join(F.broadcast(stats)).select(
        doc_key,
        "tok",
        (
            F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
        ).alias("w"),
    )
    return part.join(hint(asked), "tok").groupBy(query_key, doc_key).agg(F.sum(F.col("qn") * F.col("w")).alias("score"))


def rank(
    scores: DataFrame, limit: int, doc_key: str = "doc_id", query_key: str = "query_id", digits: int = 6
) -> DataFrame:
    """The top of each query: score descending (rounded, so that engines agree), then the smaller document; rank from 1."""
    rounded = scores.withColumn("score", F.round("score", digits))
    at = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), doc_key)).cast("long")
    return rounded.withColumn("rank", at).where(F.col("rank") <= limit)


def search(
    docs: DataFrame,
    queries: DataFrame,
    limit: int = 10,
    doc_key: str = "doc_id",
    query_key: str = "query_id",
    fill_zero: bool = True,
) -> DataFrame:
    """(query, doc, score, rank). With fill_zero each query has min(limit, documents) rows: documents without a shared
    term have the score 0 and take part by their ids, before documents of a negative score (which the mean idf of tiny
    collections may give).

    Only the smallest ids among the documents of score 0 can be in a top list. A prefix of all ids, 2 * limit at first,
    holds enough of them for a query with fewer than limit hits. Where a query's hits are many and mostly negative, the
    prefix grows until it holds what the query lacks.
    """
    docs = written(docs.select(doc_key, "toks"))  # texts are split into terms once
    top = written(rank(score(docs, queries, doc_key, query_key), limit, doc_key, query_key))
    asked = queries.select(query_key).distinct()
    above = top.where("score > 0").groupBy(query_key).agg(F.count("*").alias("n"))
    lacks = asked.join(above, query_key, "left").select(
        query_key, (limit - F.coalesce("n", F.lit(0))).alias("lack")
    ).where("lack > 0")
    if fill_zero and not (lacks := written(lacks)).isEmpty():
        hits = rank(
            score(docs, queries.join(lacks, query_key, "left_semi"), doc_key, query_key), 1 << 60, doc_key, query_key
        )
        hits = written(hits.where("score != 0").select(query_key, doc_key))
        length, total = 2 * limit, docs.count()
        while True:
            ids = docs.select(doc_key).orderBy(doc_key).limit(length)
            zero = lacks.join(ids).join(hits, [query_key, doc_key], "left_anti").select(
                query_key, doc_key, F.lit(0.0).alias("score")
            )
            found = zero.groupBy(query_key).agg(F.count("*").alias("n"))
            if length >= total or lacks.join(found, query_key, "left").where(
                F.coalesce("n", F.lit(0)) < F.col("lack")
            ).isEmpty():
                break
            length *= 8
        top, past = written(
            rank(
                top.where("score != 0").select(query_key, doc_key, "score").unionByName(zero), limit, doc_key, query_key
            ),
        ), top
        discard(past, hits, lacks)
    discard(docs)
    return top


def lookup(ranked: DataFrame, docs: DataFrame, doc_key: str, columns: list[str]) -> DataFrame:
    """Ranked rows with the texts of their documents, empty where one is missing."""
    own = docs.select(doc_key, *columns)
    return ranked.join(own, doc_key, "left").withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in columns})
