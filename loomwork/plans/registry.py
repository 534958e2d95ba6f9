"""How the query modules register: a function of (spark, load) and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry(dict):
    """name -> (query(spark, sf_dir), sql or null)."""

    def __call__(self, sql: str | None = None):
        def add(f: Callable):
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

            query.__name__, query.__doc__ = f.__name__, f.__doc__
            self[f.__name__] = (query, sql)
            return f

        return add
