"""Row numbers without a single-task window: a written range partitioning, its counts, then a local number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def numbered(df: DataFrame, order: list[str | Column], name: str = "ordinal") -> DataFrame:
    """df with the place of each row (from 0) in the given order; rows that tie in it have an arbitrary but fixed order.

    Rows are sorted over range partitions, so that no task sees all of them, and written with the number of their
    partition and their place in it. The sizes of the partitions before, one row each, are added. A lost executor can't
    change numbers that were given, since all are taken from the written table.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    dealt = written(ranged.withColumn("part__", F.spark_partition_id()).withColumn("at__", place))
    sizes = dealt.groupBy("part__").agg(F.count("*").alias("n__"))
    before = F.coalesce(
        F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    both = dealt.join(F.broadcast(sizes.select("part__", before.alias("before__"))), "part__")
    return both.withColumn(name, F.col("before__") + F.col("at__")).drop("part__", "at__", "before__")


def chunked(df: DataFrame, order: list[str | Column], size: int, name: str = "chunk", start: int = 0) -> DataFrame:
    """Chunks of `size` rows in order, numbered from start."""
    return numbered(df, order, "row__").withColumn(name, F.lit(start) + F.floor(F.col("row__") / size)).drop("row__")


def sharded(df: DataFrame, order: list[str | Column], shards: int, name: str = "shard") -> DataFrame:
    """`shards` equal shards of ceil(rows / shards) rows in order, from 0; the last ones may be smaller or empty."""
    rows = df.count()
    return chunked(df, order, max(1, -(-rows // shards)), name)
