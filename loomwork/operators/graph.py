"""Call graphs as node and edge tables; PageRank; density clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, shared_folder, written
from .dense import stacked


def call_graph(definitions: DataFrame, calls: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges. definitions (full_name, kind, class_name), calls (caller, callee, edge_type, ordinal).

    A callee that isn't defined becomes an external node; of several edges between a pair the last type stands.
    """
    edges = calls.groupBy("caller", "callee").agg(F.max_by("edge_type", order).alias("edge_type"))
    unknown = calls.select(F.col("callee").alias("full_name")).distinct().join(
        definitions, "full_name", "left_anti"
    ).select("full_name", F.lit("external").alias("kind"), F.lit(None).cast("string").alias("class_name"))
    return definitions.select("full_name", "kind", "class_name").unionByName(unknown), edges


def degrees(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, in_degree, out_degree) in one aggregation."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col(source).alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct(F.col(target).alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            ),
        ).alias("e"),
    )
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def top(scores: DataFrame, score: str, key: str, n: int) -> DataFrame:
    return scores.orderBy(F.desc(score), key).limit(n)


def pagerank(
    nodes: DataFrame,
    edges: DataFrame,
    folder: str | None = None,
    alpha: float = 0.85,
    iterations: int = 100,
    tolerance: float = 1e-6,
) -> DataFrame:
    """(node, rank) of nodes (node) and distinct edges (source, target): uniform start and teleport, the mass of nodes
    without edges spread evenly, until the ranks move less than nodes * tolerance in all. Ranks that still move after
    `iterations` rounds are an error; with a tolerance of 0 exactly that many rounds are made.

    The ranks of each round are written to the shared folder, which cuts the lineage and survives lost executors.
    """
    folder = shared_folder(nodes.sparkSession, folder)
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    out = edges.groupBy("source").agg(F.count("*").alias("n_out"))
    links = written(edges.join(out, "source").select("source", "target", "n_out"), folder)
    ranks = nodes.join(out, nodes.node == out.source, "left").select(
        "node", F.col("n_out").isNull().alias("dangling"), F.lit(1.0 / n).alias("rank")
    )
    past = None
    for _ in range(iterations):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))).first()[0]
        given = links.join(
            ranks.select(F.col("node").alias("source"), "rank"), "source"
        ).groupBy(F.col("target").alias("node")).agg(F.sum(F.col("rank") / F.col("n_out")).alias("got"))
        rank = (1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + F.lit(lost) / n)
        new = written(
            ranks.withColumnRenamed("rank", "old").join(given, "node", "left").select(
                "node", "dangling", "old", rank.alias("rank")
            ),
            folder,
        )
        if past is not None:
            discard(past)
        past, ranks = new, new.drop("old")
        if tolerance and new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < n * tolerance:
            break
    else:
        if tolerance:
            raise RuntimeError(f"ranks still move after {iterations} rounds")
    discard(links)
    return ranks.select("node", "rank")


def class_scores(methods: DataFrame, scores: DataFrame) -> DataFrame:
    """(class_name, score): the sum over a class's methods, 0 for a method without a score; methods of no class go."""
    return methods.where("class_name is not null").join(
        scores.select(F.col("node").alias("full_name"), "rank"), "full_name", "left"
    ).groupBy("class_name").agg(F.sum(F.coalesce("rank", F.lit(0.0))).alias("score"))


def of_kind(nodes: DataFrame, *kinds: str) -> DataFrame:
    return nodes.where(F.col("kind").isin(*kinds))


def dbscan(
    near: DataFrame, points: DataFrame, min_points: int, folder: str | None = None, cores: DataFrame | None = None
) -> DataFrame:
    """(id, cluster as string) of points (id) given their pairs within the radius, (a, b) with a < b: -1 is noise.

    A point with min_points points within reach, itself included, is a core; linked cores are one cluster, named by
    its smallest core; another point joins the smallest cluster among its cores. Labels spread by minima over the
    links of cores, with a shortcut each round, written to the shared folder.

    cores: the cores (id), if they are known; then near may lack links of cores that others connect anyway.
    """
    folder = shared_folder(points.sparkSession, folder)
    both = near.select(F.col("a").alias("x"), F.col("b").alias("y")).union(near.select("b", "a"))
    if cores is None:
        cores = both.groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= min_points).select(F.col("x").alias("id"))
        if min_points <= 1:
            cores = points.select("id")
    inner = written(
        both.join(
            cores.withColumnRenamed("id", "x"), "x", "left_semi"
        ).join(cores.withColumnRenamed("id", "y"), "y", "left_semi").select("x", "y"),
        folder,
    )
    label = written(cores.select("id", F.col("id").alias("c")), folder)
    past = None
    while True:
        low = inner.join(
            label.select(F.col("id").alias("y"), F.col("c").alias("cy")), "y"
        ).groupBy("x").agg(F.min("cy").alias("m"))
        step = label.join(low, label.id == low.x, "left").select(
            "id", "c", F.least("c", F.coalesce("m", "c")).alias("d")
        )
        jump = step.select(F.col("id").alias("d"), F.col("d").alias("dd"))
        new = written(
            step.join(jump, "d", "left").select("id", "c", F.least("d", F.coalesce("dd", "d")).alias("n")), folder
        )
        rests = new.where("c != n").isEmpty()
        discard(label if past is None else past)
        past, label = new, new.select("id", F.col("n").alias("c"))
        if rests:
            break
    discard(inner)
    edge = both.join(
        label.select(F.col("id").alias("y"), "c"), "y"
    ).groupBy(F.col("x").alias("id")).agg(F.min("c").alias("e"))
    out = points.select("id").join(label, "id", "left").join(edge, "id", "left")
    return out.select(
        "id", F.coalesce(F.col("c").cast("string"), F.col("e").cast("string"), F.lit("-1")).alias("cluster")
    )


#: Vectors that go to all tasks at a time, and how many of them a task compares with a batch at once.
BLOCK, STRIP = 8192, 512


def _within(ids: np.ndarray, x: np.ndarray, core: np.ndarray | None, least: float):
    """Of vectors (id, v, core) against given ones: without cores, (id, n) neighbours of each given vector; with them,
    pairs (id, n) of a given core and a vector in reach, of which a core is left out if the pairs before connect it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            docs, y = batch.column("id").to_numpy(), unit(stacked(batch.column("v"), x.shape[1]))
            group = np.arange(len(docs))
            for at in range(0, len(ids), STRIP):
                own = ids[at : at + STRIP]
                hit = (np.round(x[at : at + STRIP] @ y.T, 6) >= least) & (own[:, None] != docs[None, :])
                if core is None:
                    n = hit.sum(1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[n > 0]), pa.array(n[n > 0].astype(np.int64))], ["id", "n"]
                    )
                    continue
                inner = batch.column("core").to_numpy(zero_copy_only=False)
                pairs = []
                for q in np.flatnonzero(core[at : at + STRIP] & hit.any(axis=1)):
                    to = np.flatnonzero(hit[q] & inner)
                    labels, first = np.unique(group[to], return_index=True)
                    if len(labels) > 1:
                        group[np.isin(group, labels)] = labels[0]
                    pairs += [(own[q], docs[m]) for m in (*to[first], *np.flatnonzero(hit[q] & ~inner))]
                if pairs:
                    a, b = np.array(pairs, np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["id", "n"])

    return run


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(size == 0, 1, size)


def _blocks(v: DataFrame, least: float, with_cores: bool, folder: str) -> DataFrame:
    """(id, n) of _within() for all vectors, BLOCK of them at a time through the driver; nothing is shuffled."""
    out, held = None, []

    def block() -> DataFrame:
        ids, x = np.array([r.id for r in held], np.int64), unit(np.array([r.v for r in held], np.float64))
        core = np.array([r.core for r in held], bool) if with_cores else None
        met = written(v.mapInArrow(_within(ids, x, core, least), "id long, n long"), folder)
        return met if out is None else out.union(met)

    for row in v.toLocalIterator():
        held.append(row)
        if len(held) == BLOCK:
            out, held = block(), []
    if held:
        return block()
    return v.sparkSession.createDataFrame([], "id long, n long") if out is None else out


def dbscan_vectors(vectors: DataFrame, least: float, min_points: int, folder: str | None = None) -> DataFrame:
    """dbscan() of (id, v): all pairs of vectors with a cosine (to six digits) of `least` or more are within the radius.

    Every vector is compared with every other, twice: for its number of neighbours, and for the links of cores. A task
    leaves out links that only repeat a connection, so a dense group doesn't give rows by its square. Null vectors are
    noise. All ids are distinct, all vectors of one dimension.
    """
    folder = shared_folder(vectors.sparkSession, folder)
    points = vectors.select(F.col("id").cast("long").alias("id"))
    v = written(
        vectors.where("v is not null").select(
            F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")
        ),
        folder,
    )
    counts = _blocks(v, least, False, folder).groupBy("id").agg(F.sum("n").alias("n"))
    cores = written(
        v.join(counts, "id", "left").where(F.coalesce("n", F.lit(0)) + 1 >= min_points).select("id"), folder
    )
    marked = written(
        v.join(cores.withColumn("core", F.lit(True)), "id", "left").select(
            "id", "v", F.coalesce("core", F.lit(False)).alias("core")
        ),
        folder,
    )
    near = _blocks(marked, least, True, folder).select(
        F.least("id", "n").alias("a"), F.greatest("id", "n").alias("b")
    ).distinct()
    return dbscan(near, points, min_points, folder, cores)


def cluster_frame(clusters: DataFrame, points: DataFrame) -> DataFrame:
    """points (id, ...) with `cluster` and the size of it, 0 for noise."""
    sizes = clusters.where("cluster != '-1'").groupBy("cluster").agg(F.count("*").alias("size"))
    return points.join(clusters, "id").join(sizes, "cluster", "left").select(
        *points.columns, "cluster", F.coalesce("size", F.lit(0)).alias("size")
    )


def cluster_counts(clusters: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One row: clusters without the noise, and noise points."""
    c = F.col(cluster)
    return clusters.agg(
        F.count_distinct(F.when(c != "-1", c)).alias("n_clusters"), F.count_if(c == "-1").alias("n_noise")
    )


def resolve_calls(calls: DataFrame, lookups: list[tuple[str, DataFrame]]) -> DataFrame:
    """calls (caller, symbol, ...) with `callee` from the first lookup (symbol column of calls, table of (key, full_name))
    that knows it."""
    out, found = calls, []
    for i, (column, table) in enumerate(lookups):
        out = out.join(table.select(F.col("key").alias(column), F.col("full_name").alias(f"l{i}__")), column, "left")
        found.append(F.col(f"l{i}__"))
    return out.withColumn("callee", F.coalesce(*found)).drop(*(f"l{i}__" for i in range(len(lookups))))


def symbol_index(refs: DataFrame, symbols: str = "symbols", ref: str = "ref") -> DataFrame:
    """(symbol, refs): for each symbol the sorted distinct places that call it."""
    return refs.select(F.explode(symbols).alias("symbol"), ref).groupBy("symbol").agg(
        F.array_sort(F.collect_set(ref)).alias("refs")
    )


def reduce_dimensions(df: DataFrame, vector: str, k: int) -> DataFrame:
    """df with `reduced`: the coordinates along the k principal components, a stand-in for the neighbour embedding of a
    plot. The largest loading of each component is positive, so that the result doesn't depend on the solver."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    from ..functions import vectors as vx

    v = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    loadings = PCA(k=k, inputCol="v", outputCol="r").fit(v).pc.toArray().T
    loadings = [row * np.sign(row[np.abs(row).argmax()]) for row in loadings]
    axes = [F.array(*(F.lit(float(x)) for x in row)) for row in loadings]
    return df.withColumn("reduced", F.array(*(vx.dot(F.col(vector), axis) for axis in axes)))


def external_url(repo: str, ref: str, path: Column, line: Column) -> Column:
    return F.concat(
        F.lit(f"{repo}/blob/{ref}/"), path, F.coalesce(F.concat(F.lit("#L"), line.cast("string")), F.lit(""))
    )
