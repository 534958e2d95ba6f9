"""Shared plumbing: intermediate tables, connected components, Arrow helpers."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (see session.shared_folder())."""
    return shared_folder(spark)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writers: dict[str, tuple[int, str]] = {}  # of each session: writes under way, and the setting before the first


@contextlib.contextmanager
def cleaned(spark: SparkSession):
    """Within it, the shuffle files behind each write go as soon as the written table is complete. The session's setting
    comes back when the last of several writes that run side by side is done."""
    name = f"{spark.sparkContext.applicationId}-{id(spark._jsparkSession)}"
    with _lock:
        n, before = _writers.get(name, (0, spark.conf.get(CLEANUP, "false")))
        _writers[name] = n + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _writers.pop(name)
            if n > 1:
                _writers[name] = n - 1, before
            else:
                spark.conf.set(CLEANUP, before)


def spill(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.spilled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of spill() that nothing reads any more: what was derived from them is itself a written table."""
    for t in tables:
        discard_path(t.sparkSession, t.spilled_at)


def discard_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store that Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Bytes of a small table that one task writes.
TASK_BYTES = 8 << 20


def few(df: DataFrame, size: int | None) -> DataFrame:
    """df, whose rows take `size` bytes at most, in tasks of about TASK_BYTES where that makes fewer than the session's.

    Adaptive execution does so where it may join partitions; elsewhere a table of some kilobytes would become a file for
    each shuffle partition, and in a local folder Hadoop starts processes (chmod) for each file.
    """
    n = -(-int(size or 1) // TASK_BYTES)
    return df.coalesce(n) if n < shuffle_partitions(df.sparkSession) else df


def held_out(doc_id: str = "doc_id"):
    """crc32 of the decimal doc_id, modulo 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each piece hold about `most` bytes (a longer text stands alone)."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at, n = 0, len(size)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def in_slices(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text", most: int = 1 << 20):
    """A function for mapInArrow that applies f to slices of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, column, most):
                out = f(piece)
                if out is not None and out.num_rows:
                    yield out

    return run


def members_then_visitors(key: str, handle: Callable):
    """A function for mapInArrow over rows sorted by (key, kind): the rows of kind 0 of a key are held, those of kind 1
    pass by, batch after batch. handle(table of kind 0) returns a function of a batch of kind 1 that yields batches, and
    is called with null at the key's end; keys without both kinds are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, visit = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in (key, "kind"))
            cuts = [0, *((keys[1:] != keys[:-1]) | (kind[1:] != kind[:-1])).nonzero()[0] + 1, len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if keys[lo] != now:
                    if visit:
                        yield from visit(None)
                    now, held, visit = keys[lo], [], None
                part = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    held.append(part)
                elif held or visit:
                    if not visit:
                        visit, held = handle(pa.Table.from_batches(held)), []
                    yield from visit(part)
        if visit:
            yield from visit(None)

    return run


#: Keys that hold more than one of so many rows count as crowded; so at most so many do.
MOST_HOT = 10_000


def crowd(rows: int) -> int:
    """From how many rows on a key is crowded, of so many rows in all; a few hundred rows never are."""
    return max(256, rows // MOST_HOT)


def spread_join(df: DataFrame, facts: DataFrame, key: str, rows: int) -> DataFrame:
    """df (of `rows` rows) joined with one row of facts for each key, whose column n__ is the key's number of rows in df.

    Rows of crowded keys, of which there are MOST_HOT at most, aren't dealt by key: the facts of these go to all tasks.
    """
    hot = facts.where(F.col("n__") > crowd(rows)).drop("n__")
    rest = facts.where(F.col("n__") <= crowd(rows)).drop("n__")
    ordinary = df.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return ordinary.unionByName(df.join(F.broadcast(hot), key))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list as (id, component), component the smallest id.

    Alternating large-star and small-star steps (Kiveris et al., 2014): the edge list converges to stars whose
    centres are the minima. Every step is a partial aggregation and a join, which spreads the edges of a large star's
    centre, written to the shared folder. Nodes without edges are absent.
    """
    now = spill(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u < v").distinct(), "edges")
    known, n = None, now.count()
    for _ in range(rounds if n else 0):
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).union(now.select("u", "v"))
        low = both.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n__")).withColumn("m", F.least("x", "m"))
        large = spread_join(both.where("y > x"), low, "x", 2 * n).select(
            F.col("y").alias("v"), F.col("m").alias("u")
        ).where("u < v").distinct()
        small_low = large.groupBy("v").agg(F.min("u").alias("m"))
        pair = lambda v, u: F.struct(F.col(v).alias("v"), F.col(u).alias("u"))
        small = large.join(small_low, "v").select(
            F.explode(F.array(pair("v", "m"), pair("u", "m"))).alias("e")
        ).select("e.v", "e.u").where("u < v").distinct()
        past, now = now, spill(small, "edges")
        discard(past)
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()
        if (mark.n, mark.h) == known or mark.n == 0:
            break
        known, n = (mark.n, mark.h), mark.n
    else:
        if n:
            raise RuntimeError("components did not converge")
    return now.select(F.col("v").alias("id"), F.col("u").alias("component")).union(now.select("u", "u").distinct())


def smallest(df: DataFrame, order: list, n: int) -> DataFrame:
    """The n rows that come first by hashed order columns, order[0] a 64-bit hash.

    Rows whose hash can hardly be among the first are filtered out first, by the share that n is of all rows, so the
    partitions together send little more than n rows, however many they are. If too few are left, all rows compete.
    """
    total = df.count()
    if total > 4 * n:
        share = (1.5 * n + 100) / total
        few = df.where(F.pmod(order[0], F.lit(1 << 40)) < int(share * (1 << 40)))
        if few.count() >= n:
            return few.orderBy(F.pmod(order[0], F.lit(1 << 40)), *order[1:]).limit(n)
    return df.orderBy(F.pmod(order[0], F.lit(1 << 40)), *order[1:]).limit(n)


def chosen_texts(docs: DataFrame, chosen: DataFrame, *keys: str) -> DataFrame:
    """The rows of docs (keys and text) that a bounded table of distinct keys names, one for each of its rows.

    However often docs repeats a key, one text stands for it (the one of the smallest hash), so the bound of the table
    is a bound of the rows.
    """
    names = [f"k{i}__" for i in range(len(keys))]
    right = chosen.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    met = docs.where("text is not null").select(*keys, "text").join(F.broadcast(right), same)
    rest = [c for c in chosen.columns if c not in keys]
    return met.groupBy(*keys, *rest).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def first_of_each(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The n rows of each group that come first by hashed order columns, order[0] a 64-bit hash.

    As in smallest(), rows whose hash can hardly be among the first of their group are filtered out first, so that a
    group's window meets little more than n rows, however many the group has and over however many partitions.
    """
    place = F.pmod(order[0], F.lit(1 << 40))
    most = df.groupBy(group).agg(F.count("*").alias("n__")).withColumnRenamed(group, "g__")
    most = most.select("g__", F.least(F.lit(1.0), (F.lit(1.5 * n + 100)) / F.col("n__")).alias("share__"))
    few = df.join(
        most, F.col(group).eqNullSafe(F.col("g__"))
    ).where(place < F.col("share__") * (1 << 40)).drop("g__", "share__")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(place, *order[1:]))
    return few.withColumn("rank", rank).where(F.col("rank") <= n)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
