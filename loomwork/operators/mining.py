"""Training tables: hard negatives, diverse subsets, splits, triples, neighbour batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import shared_folder, written
from .fusion import merge


def windowed_negatives(ranked: DataFrame, texts: DataFrame, positives: DataFrame, start: int, most: int) -> DataFrame:
    """(query_id, negatives): of each anchor's ranked list, the anchor's own document left out first, the distinct
    non-blank texts from place `start` on, in order, `most` of them; never the positive text.

    ranked: (query_id, doc_id, rank); texts: (doc_id, text); positives: (query_id, doc_id, text). The walk down the
    list is an aggregation: the first place of each text at or behind `start`, then the first `most` of those.
    """
    own = positives.select("query_id", F.col("doc_id").alias("own"), tx.trim(F.col("text")).alias("positive"))
    rest = ranked.join(own, "query_id").where(F.col("doc_id") != F.col("own"))
    placed = rest.withColumn(
        "at", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    ).where(F.col("at") >= start)
    named = placed.join(
        texts.select("doc_id", tx.trim(F.col("text")).alias("text")), "doc_id"
    ).where((F.col("text") != "") & (F.col("text") != F.col("positive")))
    return first_texts(named, most)


def first_texts(named: DataFrame, most: int) -> DataFrame:
    """(query_id, negatives) of (query_id, text, at): each text at its first place, the first `most`, in order."""
    once = named.groupBy("query_id", "text").agg(F.min("at").alias("at"))
    kept = once.withColumn(
        "n", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))
    ).where(F.col("n") <= most)
    return kept.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda s: s["text"]).alias("negatives")
    )


def sliced_negatives(ranked: DataFrame, texts: DataFrame, drop: int, keep: int) -> DataFrame:
    """(query_id, negatives): places drop + 1 to drop + keep of each list without the anchor, blanks removed, repeats kept."""
    rest = ranked.where("query_id != doc_id").withColumn(
        "at", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    )
    named = rest.where(
        F.col("at").between(drop + 1, drop + keep)
    ).join(texts, "doc_id").where(~tx.is_blank(F.col("text")))
    return named.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]).alias("negatives")
    )


def mine(
    dense: DataFrame, sparse: DataFrame, texts: DataFrame, positives: DataFrame, start: int = 6, most: int = 32
) -> DataFrame:
    """Hard negatives from both searches: (query_id, positive, negatives) of queries with a positive and a negative.

    dense, sparse: (query_id, doc_id, rank) pools of each query; texts: (doc_id, text); positives: (query_id, doc_id,
    text). The pools are fused by reciprocal rank, and the fused list is walked as windowed_negatives() says.
    """
    negatives = windowed_negatives(merge(dense, sparse), texts, positives, start, most)
    return with_negatives(
        positives.select("query_id", tx.trim(F.col("text")).alias("positive")).join(negatives, "query_id")
    )


def mine_fields(
    pools: dict[str, tuple[DataFrame, DataFrame]], texts: DataFrame, drop: int = 5, keep: int = 32
) -> DataFrame:
    """Negatives by field: (query_id, negative_<field>, ...) of each field's own fused pools, a row for each query that any
    field has; a field without one is an empty list.

    pools: for each field its (dense, sparse) lists; texts: (doc_id, a column for each field). Lists are sliced as
    sliced_negatives() says.
    """
    out = None
    for field, (dense, sparse) in pools.items():
        ranked = merge(dense, sparse).select("query_id", "doc_id", "rank")
        own = sliced_negatives(
            ranked, texts.select("doc_id", F.col(field).alias("text")), drop, keep
        ).withColumnRenamed("negatives", f"negative_{field}")
        out = own if out is None else out.join(own, "query_id", "full")
    return out.select(
        "query_id",
        *(F.coalesce(f"negative_{f}", F.array().cast("array<string>")).alias(f"negative_{f}") for f in pools),
    )


def with_negatives(rows: DataFrame, column: str = "negatives") -> DataFrame:
    """Rows with at least one negative."""
    return rows.where(F.size(column) > 0)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def triples(rows: DataFrame) -> DataFrame:
    """anchor, positive and the first negative."""
    return with_negatives(rows).select(
        F.col("question").alias("anchor"), F.col("positive"), F.get("negatives", 0).alias("negative")
    )


def similarity(groups: DataFrame, key: str, item: str, vector: str) -> DataFrame:
    """Cosine of all pairs (a <= b) of items that share a group; groups are small by their nature (a row's questions)."""
    from ..functions import vectors as vx

    unit = groups.select(key, F.col(item).alias("a"), vx.normalize(F.col(vector)).alias("va"))
    return unit.join(
        unit.select(key, F.col("a").alias("b"), F.col("va").alias("vb")), key
    ).where("a <= b").select(key, "a", "b", vx.dot(F.col("va"), F.col("vb")).alias("similarity"))


def mmr_order(x: np.ndarray, n: int, weight: float) -> list[int]:
    """Maximal marginal relevance: the row of the highest mean similarity (itself included), then each time the row of
    the highest weight * relevance - (1 - weight) * largest similarity to the chosen; the first of equals."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(size == 0, 1, size)
    sim = np.round(unit @ unit.T, 9)
    relevance = np.round(sim.mean(axis=1), 9)
    chosen = [int(relevance.argmax())]
    near = sim[chosen[0]].copy()
    while len(chosen) < n:
        value = weight * relevance - (1 - weight) * near
        value[chosen] = -np.inf
        chosen.append(int(np.round(value, 9).argmax()))
        near = np.maximum(near, sim[chosen[-1]])
    return chosen


def diverse_subset(df: DataFrame, key: str, item: str, vector: str, n: int, weight: float = 0.5) -> DataFrame:
    """(key, item, pick): n items of each group by MMR, pick from 1. A group with fewer is an error. Each choice depends
    on the earlier ones, so a group (a row's few questions) is handled at once."""
    kind = df.schema[item].dataType.simpleString()

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item, kind="stable")
        if len(pdf) < n:
            raise ValueError(f"{len(pdf)} candidates for {n} picks")
        picks = mmr_order(np.array(pdf[vector].tolist(), np.float64), n, weight)
        return pd.DataFrame(
            {key: pdf[key].iloc[0], item: pdf[item].iloc[picks].to_numpy(), "pick": np.arange(1, n + 1)}
        )

    return df.where(F.col(vector).isNotNull()).groupBy(key).applyInPandas(
        choose, f"{key} {df.schema[key].dataType.simpleString()}, {item} {kind}, pick int"
    )


def diverse_subset_of_large(
    df: DataFrame, key: str, item: str, vector: str, n: int, folder: str | None = None, weight: float = 0.5
) -> DataFrame:
    """diverse_subset() of groups of any size: no task sees a whole group, and no pairs are made.

    The mean similarity of a row is its product with the mean of the unit vectors. Each pick is one aggregation by key
    and one join that moves each row's largest similarity to the chosen; a round is written to the shared folder.
    """
    from ..functions import vectors as vx
    from .dense import mean_pool

    folder = shared_folder(df.sparkSession, folder)
    kind = df.schema[key].dataType
    base = df.where(F.col(vector).isNotNull()).select(
        F.col(key).alias("k"), F.col(item).alias("i"), vx.normalize(F.col(vector)).alias("u")
    )
    few = base.groupBy("k").count().where(F.col("count") < n).first()
    if few:
        raise ValueError(f"{few['count']} candidates for {n} picks")
    means = mean_pool(base, "k", "u").select(F.col("k").alias("mk"), "pooled")
    now = base.join(means, F.col("k").eqNullSafe(F.col("mk"))).select(
        "k",
        "i",
        "u",
        F.round(vx.dot(F.col("u"), F.col("pooled")), 9).alias("relevance"),
        F.lit(None).cast("double").alias("near"),
        F.lit(None).cast("int").alias("pick"),
    )
    for turn in range(1, n + 1):
        now = written(now, folder)
        value = F.col("relevance") if turn == 1 else F.round(
            weight * F.col("relevance") - (1 - weight) * F.col("near"), 9
        )
        best = now.where("pick is null").groupBy("k").agg(
            F.min_by(F.struct("i", "u"), F.struct((-value).alias("v"), "i")).alias("b")
        ).select(F.col("k").alias("bk"), F.col("b.i").alias("bi"), F.col("b.u").alias("bu"))
        moved = F.greatest("near", F.round(vx.dot(F.col("u"), F.col("bu")), 9))
        now = now.join(best, F.col("k").eqNullSafe(F.col("bk"))).select(
            "k",
            "i",
            "u",
            "relevance",
            moved.alias("near"),
            F.when(F.col("i") == F.col("bi"), F.lit(turn)).otherwise(F.col("pick")).alias("pick"),
        )
    return now.where("pick is not null").select(F.col("k").cast(kind).alias(key), F.col("i").alias(item), "pick")


def hash_order(key: str, seed: int) -> Column:
    """A reproducible shuffle: md5 of seed and key, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")).cast("binary"))


def kth_smallest(df: DataFrame, h: str, key: str, k: int, small: int = 50_000) -> tuple:
    """(h, key) of the k-th row (from 1) by h, then key; h is hexadecimal text.

    Counts of the next three digits (4,096 values at most) narrow the place down until few rows are left to sort, so no
    task or driver sees more than `small` rows, however large k is.
    """
    prefix = ""
    while True:
        inside = df.where(F.col(h).startswith(prefix))
        counts = sorted(inside.groupBy(F.substring(h, 1, len(prefix) + 3).alias("p")).count().collect())
        for p, n in counts:
            if k <= n:
                prefix = p
                break
            k -= n
        if n <= small or len(prefix) >= 30:
            row = df.where(F.col(h).startswith(prefix)).select(h, key).orderBy(h, key).limit(k).agg(
                F.max(F.struct(h, key)).alias("e")
            ).first().e
            return row[h], row[key]


def split(df: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """df with `is_validation` for max(1, floor(rows * ratio)) rows, all but one at most; ratio must be within 0 and 1.

    The rows are those of the smallest hashes; equal hashes go by key.
    """
    if not 0 < ratio < 1:
        raise ValueError("the ratio must lie between 0 and 1")
    total = df.count()
    take = min(max(1, int(total * ratio)), total - 1)
    marked = df.withColumn("h__", hash_order(key, seed))
    if take < 1:
        return marked.withColumn("is_validation", F.lit(False)).drop("h__")
    h, k = kth_smallest(marked, "h__", key, take)
    return marked.withColumn(
        "is_validation", (F.col("h__") < h) | ((F.col("h__") == h) & (F.col(key) <= k))
    ).drop("h__")


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """min(n, rows) rows without replacement."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def split_questions(
    rows: DataFrame,
    key: str,
    questions: str,
    train: int = 2,
    validation: int = 1,
    seed: int | None = None,
    exact: bool = True,
) -> DataFrame:
    """(key, question, part): the first questions of a row (after a hashed shuffle if a seed is given) go to train, the
    next to validation. Rows with another number are an error, or left out if not exact and they have too few."""
    items = F.col(questions)
    if seed is not None:
        pairs = F.array_sort(
            F.transform(
                items,
                lambda q, i: F.struct(
                    F.md5(
                        F.concat(
                            F.lit(f"{seed}-"), F.col(key).cast("string"), F.lit("-"), i.cast("string")
                        ).cast("binary"),
                    ).alias("h"),
                    q.alias("q"),
                ),
            ),
        )
        items = F.transform(pairs, lambda p: p["q"])
    want = train + validation
    base = rows.where(F.size(questions) >= want) if not exact else rows.select(
        "*",
        F.when(
            F.size(questions) != want, F.raise_error(F.lit(f"a row has not {want} questions")).cast("int")
        ).alias("check__"),
    ).where(F.col("check__").isNull()).drop("check__")
    out = base.select(key, F.posexplode(items).alias("at", "question")).where(F.col("at") < want)
    return out.select(key, "question", F.when(F.col("at") < train, "train").otherwise("validation").alias("part"))


def pick_one(items: Column, key: Column, seed: int, epoch: int = 0) -> Column:
    """One item of an array, chosen by a hash of seed, epoch and key, the same in every engine; null if there is none."""
    digest = F.md5(F.concat(F.lit(f"{seed + epoch}-"), key.cast("string")).cast("binary"))
    number = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long")
    return F.when(F.size(items) > 0, F.get(items, F.pmod(number, F.size(items).cast("long")).cast("int")))


def question_pairs(rows: DataFrame, name: str, questions: str, drop_unnamed: bool = True) -> DataFrame:
    """(question, expected) pairs, blanks left out."""
    pairs = rows.select(
        F.explode(questions).alias("question"), tx.trim(F.coalesce(F.col(name), F.lit(""))).alias("expected")
    ).where(~tx.is_blank(F.col("question")))
    return pairs.where("expected != ''") if drop_unnamed else pairs


def retrieval_tables(rows: DataFrame, query: str, document: str, order: Column) -> tuple[DataFrame, DataFrame]:
    """Documents (document_index, document), distinct in the order they first appear, and queries (query,
    document_index)."""
    first = rows.groupBy(document).agg(F.min(order).alias("o__"))
    from ..sources.ordinals import numbered

    docs = numbered(first, ["o__"], "document_index").select("document_index", F.col(document).alias("document"))
    return docs, rows.join(docs, rows[document] == docs["document"]).select(
        F.col(query).alias("query"), "document_index"
    )


def neighbour_batches(graph: DataFrame, size: int, folder: str | None = None) -> DataFrame:
    """(batch, place, id): batches of up to `size` ids that share none, an anchor with its nearest free neighbours.
    graph: (id, neighbours as an ordered array).

    Anchors come in the order of their ids; one that an earlier batch holds is passed over, and one without a free
    neighbour makes no batch and stays free. An anchor's choice depends only on anchors that reach for the same ids, so
    in each round all anchors choose that are the smallest to reach for each of their free ids. What is chosen falls away,
    until no reach is left. The rounds are as many as the longest chain of anchors that wait for each other.
    """
    spark = graph.sparkSession
    folder = shared_folder(spark, folder)
    near = graph.select(
        F.col("id").cast("long").alias("anchor"), F.posexplode("neighbours").alias("at", "id")
    ).where("id is not null and id != anchor")
    near = near.groupBy("anchor", F.col("id").cast("long").alias("id")).agg(F.min("at").alias("at"))
    own = graph.select(
        F.col("id").cast("long").alias("anchor"), F.col("id").cast("long").alias("id"), F.lit(-1).alias("at")
    ).distinct()
    reach, chosen = written(own.unionByName(near), folder), None
    while not reach.isEmpty():
        first = reach.groupBy("id").agg(F.min("anchor").alias("first"))
        waits = reach.join(first, "id").groupBy("anchor").agg(F.max(F.col("first") != F.col("anchor")).alias("waits"))
        ready = written(reach.join(waits.where("not waits").select("anchor"), "anchor", "left_semi"), folder)
        order = F.row_number().over(Window.partitionBy("anchor").orderBy("at")) - 1
        batch = ready.withColumn("place", order.cast("long")).where(F.col("place") < size)
        batch = written(
            batch.withColumn(
                "n", F.count("*").over(Window.partitionBy("anchor"))
            ).where("n > 1").select("anchor", "place", "id"),
            folder,
        )
        chosen = batch if chosen is None else chosen.unionByName(batch)
        gone = batch.select("id")
        left = reach.join(ready.select("anchor").distinct(), "anchor", "left_anti").join(gone, "id", "left_anti")
        reach = written(left.join(gone.withColumnRenamed("id", "anchor"), "anchor", "left_anti"), folder)
    if chosen is None:
        return spark.createDataFrame([], "batch long, place long, id long")
    from ..sources.ordinals import numbered

    numbers = numbered(chosen.where("place = 0").select("anchor"), ["anchor"], "batch")
    return chosen.join(numbers, "anchor").select("batch", "place", "id")


def batch_size(total: int | None, per_device: int | None, devices: int = 1, accumulation: int = 1) -> tuple[int, int]:
    """Per-device batch and accumulation steps that reach a global batch: ceil(global / (per device * devices))."""
    if total is None:
        return per_device or 1, accumulation
    per = per_device or max(1, -(-total // devices))
    return per, max(1, -(-total // (per * devices)))
