"""Greedy packing of rows into shards of a budget: a running sum that starts anew at each shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def pack(df: DataFrame, group: list[str], order: list[str], cost: str, budget: int, name: str = "shard") -> DataFrame:
    """df with the shard of each row, from 0 in each group: a row opens a new shard if the current one has something in
    it and would exceed the budget; a single row beyond the budget has a shard to itself. Null costs are 0.

    The rule depends on every earlier row of the group, so a group is sorted in one task; it streams through it, and
    only the running sum is held. Give the natural groups (input files) as `group` to run them side by side.
    """
    names = df.columns
    schema = StructType([*df.schema.fields, StructField(name, LongType())])
    sorted_ = df.repartition(*group).sortWithinPartitions(*group, *order) if group else df.coalesce(1).sortWithinPartitions(*order)
    keyed = sorted_.withColumn("group__", F.to_json(F.struct(*group)) if group else F.lit(""))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, held = None, 0, 0
        for batch in batches:
            costs = batch.column(cost).fill_null(0).to_numpy(zero_copy_only=False)
            out = np.zeros(len(costs), np.int64)
            for i, (key, c) in enumerate(zip(batch.column("group__").to_pylist(), costs, strict=True)):
                if key != now:
                    now, shard, held = key, 0, 0
                if held and held + c > budget:
                    shard, held = shard + 1, 0
                held += c
                out[i] = shard
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out)], [*names, name])

    return keyed.mapInArrow(walk, schema)
