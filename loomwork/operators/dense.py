"""Exact vector ranking: query blocks against all rows, per-partition top lists, one small merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries compared at once; a block is that many vectors, whatever the number of queries.
BLOCK = 4096


def stacked(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dim)


def top_of(ids: np.ndarray, queries: np.ndarray, limit: int, metric: str, exclude_self: bool, digits: int):
    """The best `limit` documents of a partition for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_s, best_d = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            docs, s = similarities(batch, ids, queries, metric, exclude_self)
            best_s = np.concatenate([best_s, np.round(s, digits)], 1)
            best_d = np.concatenate([best_d, np.broadcast_to(docs, s.shape)], 1)
            if best_s.shape[1] > limit:
                order = np.lexsort((best_d, -best_s), axis=1)[:, :limit]
                best_s, best_d = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_d, order, 1)
        some = np.isfinite(best_s)
        if some.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, some.sum(1))), pa.array(best_d[some]), pa.array(best_s[some])],
                ["query_id", "doc_id", "score"],
            )

    return run


def scored(ids: np.ndarray, queries: np.ndarray, metric: str, exclude_self: bool):
    """The scores of all documents of a partition for each query, a batch of documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            docs, s = similarities(batch, ids, queries, metric, exclude_self)
            some = np.isfinite(s)
            cols = [np.repeat(ids, some.sum(1)), np.broadcast_to(docs, s.shape)[some], s[some]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "doc_id", "score"])

    return run


def best_of_name(ids: np.ndarray, queries: np.ndarray, names: list[str], metric: str, exclude_self: bool, digits: int):
    """Of documents with a name: the best (score, document) of each query among those of its own name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            docs, s = similarities(batch, ids, queries, metric, exclude_self)
            own = np.array(batch.column("name").to_pylist(), object)[None, :] == np.array(names, object)[:, None]
            s = np.where(own, np.round(s, digits), -np.inf)
            first = np.lexsort((np.broadcast_to(docs, s.shape), -s), axis=1)[:, 0]
            top = np.take_along_axis(s, first[:, None], 1)[:, 0]
            some = np.isfinite(top)
            cols = [ids[some], docs[first[some]], top[some]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "doc_id", "score"])

    return run


def ahead_of(
    ids: np.ndarray,
    queries: np.ndarray,
    best: np.ndarray,
    best_doc: np.ndarray,
    metric: str,
    exclude_self: bool,
    digits: int,
):
    """How many documents come before the given best one of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            docs, s = similarities(batch, ids, queries, metric, exclude_self)
            s = np.round(s, digits)
            n = ((s > best[:, None]) | ((s == best[:, None]) & (docs[None, :] < best_doc[:, None]))).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], ["query_id", "n"])

    return run


def similarities(
    batch: pa.RecordBatch, ids: np.ndarray, queries: np.ndarray, metric: str, exclude_self: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a batch and the scores (query, document); -inf for the query itself, if that is left out."""
    x, docs = stacked(batch.column("v"), queries.shape[1]), batch.column("doc").to_numpy()
    s = queries @ x.T
    if metric == "l2":
        s = 1 - ((queries * queries).sum(1)[:, None] - 2 * s + (x * x).sum(1)[None, :])
    return docs, np.where(ids[:, None] == docs[None, :], -np.inf, s) if exclude_self else s


def vectors_of(df: DataFrame, vector: str, key: str, name: str, *more: Column) -> DataFrame:
    return df.where(F.col(vector).isNotNull()).select(
        F.col(key).cast("long").alias(name), F.col(vector).cast("array<double>").alias("v"), *more
    )


def blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(ids, vectors, rows) of BLOCK queries (q, v, ...) at a time."""
    held = []
    for row in queries.toLocalIterator():
        held.append(row)
        if len(held) == BLOCK:
            yield np.array([r.q for r in held], np.int64), np.array([r.v for r in held], np.float64), held
            held = []
    if held:
        yield np.array([r.q for r in held], np.int64), np.array([r.v for r in held], np.float64), held


PAIRS = "query_id long, doc_id long, score double"


def union(frames: list[DataFrame], spark, schema: str) -> DataFrame:
    out = frames[0] if frames else spark.createDataFrame([], schema)
    for f in frames[1:]:
        out = out.union(f)
    return out


def search(
    docs: DataFrame,
    queries: DataFrame,
    limit: int = 10,
    vector: str = "embedding",
    doc_key: str = "doc_id",
    query_key: str = "query_id",
    metric: str = "dot",
    exclude_self: bool = False,
    digits: int = 6,
) -> DataFrame:
    """(query_id, doc_id, score, rank) of the top `limit` documents of each query: score descending, then the smaller id.

    metric: `dot`, or `l2` for 1 - squared distance. Null vectors take no part. All documents are scanned once for
    each BLOCK of queries; a task sends `limit` rows a query to the merge, however many documents it has seen. For
    lists as long as the table use scores().
    """
    base, asked = vectors_of(docs, vector, doc_key, "doc"), vectors_of(queries, vector, query_key, "q")
    met = [base.mapInArrow(top_of(ids, x, limit, metric, exclude_self, digits), PAIRS) for ids, x, _ in blocks(asked)]
    out = union(met, docs.sparkSession, PAIRS)
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")).cast("long")
    return out.withColumn("score", F.round("score", digits)).withColumn("rank", at).where(F.col("rank") <= limit)


def scores(
    docs: DataFrame,
    queries: DataFrame,
    vector: str = "embedding",
    doc_key: str = "doc_id",
    query_key: str = "query_id",
    metric: str = "dot",
    exclude_self: bool = False,
    digits: int = 6,
) -> DataFrame:
    """(query_id, doc_id, score) of every query and document; nothing is held or shuffled. Null vectors take no part."""
    base, asked = vectors_of(docs, vector, doc_key, "doc"), vectors_of(queries, vector, query_key, "q")
    met = [base.mapInArrow(scored(ids, x, metric, exclude_self), PAIRS) for ids, x, _ in blocks(asked)]
    return union(met, docs.sparkSession, PAIRS).withColumn("score", F.round("score", digits))


def first_relevant(
    docs: DataFrame,
    queries: DataFrame,
    name: str,
    vector: str = "embedding",
    doc_key: str = "doc_id",
    query_key: str = "query_id",
    metric: str = "dot",
    exclude_self: bool = False,
    digits: int = 6,
) -> DataFrame:
    """(query_id, first_rank): at which place of the full ranking the first document stands whose `name` is that of the
    query; null if none has it.

    No ranking is made: the best document of that name is found, and those before it are counted, each in one scan for
    a BLOCK of queries.
    """
    base = vectors_of(docs, vector, doc_key, "doc", F.col(name).cast("string").alias("name"))
    asked = vectors_of(queries, vector, query_key, "q", F.col(name).cast("string").alias("name"))
    spark, met = docs.sparkSession, []
    for ids, x, rows in blocks(asked):
        found = base.mapInArrow(best_of_name(ids, x, [r.name for r in rows], metric, exclude_self, digits), PAIRS)
        best = {
            r.query_id: r.b for r in found.groupBy("query_id").agg(
                F.min(F.struct((-F.col("score")).alias("s"), "doc_id")).alias("b")
            ).collect()
        }
        some = np.array([i in best for i in ids.tolist()], bool)
        if some.any():
            own = ids[some]
            top, doc = (np.array([best[i][j] for i in own.tolist()]) for j in (0, 1))
            n = base.mapInArrow(
                ahead_of(own, x[some], -top.astype(float), doc.astype(np.int64), metric, exclude_self, digits),
                "query_id long, n long",
            )
            met.append(n.groupBy("query_id").agg((F.sum("n") + 1).alias("first_rank")))
    return asked.select(F.col("q").alias("query_id")).join(
        union(met, spark, "query_id long, first_rank long"), "query_id", "left"
    )


def max_sim(queries: DataFrame, docs: DataFrame, set_key: str, item: str, vector: str, digits: int = 6) -> DataFrame:
    """(query_set, doc_set, score): the sum over a query set's vectors of their largest dot product with any vector of the
    document set. Sets of any size: a task keeps one maximum for each query vector and document set it has seen."""

    def best(ids: np.ndarray, x: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                s, sets = x @ stacked(batch.column("v"), x.shape[1]).T, batch.column("s")
                for name in sets.unique():
                    at = np.flatnonzero(np.array([v == name.as_py() for v in sets.to_pylist()]))
                    cols = [pa.array(ids), pa.repeat(name, len(ids)), pa.array(s[:, at].max(1))]
                    yield pa.RecordBatch.from_arrays(cols, ["q", "s", "m"])

        return run

    kind = docs.schema[set_key].dataType.simpleString()
    base, asked = vectors_of(docs, vector, item, "doc", F.col(set_key).alias("s")), vectors_of(
        queries, vector, item, "q", F.col(set_key).alias("qs")
    )
    met = union(
        [base.mapInArrow(best(ids, x), f"q long, s {kind}, m double") for ids, x, _ in blocks(asked)],
        docs.sparkSession,
        f"q long, s {kind}, m double",
    )
    tops = met.groupBy("q", "s").agg(F.max("m").alias("m")).join(asked.select("q", "qs"), "q")
    return tops.groupBy(
        F.col("qs").alias("query_set"), F.col("s").alias("doc_set")
    ).agg(F.round(F.sum("m"), digits).alias("score"))


def mean_pool(tokens: DataFrame, key: str, vector: str, mask: str | None = None) -> DataFrame:
    """The mean of a key's token vectors, of those whose mask isn't 0; all zero if none counts."""
    w = F.lit(1.0) if mask is None else F.col(mask).cast("double")
    flat = tokens.select(key, w.alias("w"), F.posexplode(vector).alias("i", "x"))
    sums = flat.groupBy(key, "i").agg(
        (F.sum(F.col("x").cast("double") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-9))).alias("x")
    )
    return sums.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("pooled")
    )
