"""Duplicate rules: which row of a key stays. Each is one hash or sort aggregation with a map-side part, no window.

`order` is the row's ordinal: the rules are only defined over a total order, so ties need a unique last key. Rows with
a null or empty key are dropped where a rule says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def _pick(df: DataFrame, key: list[str], order: Column, last: bool, valid: Column | None) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    row = F.struct(*rest) if rest else F.lit(True)
    kept = df if valid is None else df.where(valid)
    best = (F.max_by if last else F.min_by)(row, order)
    out = kept.groupBy(*key).agg(best.alias("row__"))
    return out.select(*(c if c in key else F.col(f"row__.{c}").alias(c) for c in df.columns))


def has_id(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) != ""


def last_by(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each id; rows without an id go."""
    return _pick(df.where(has_id(key)), [key], order, True, None)


def first_by(df: DataFrame, key: str, order: Column) -> DataFrame:
    return _pick(df.where(has_id(key)), [key], order, False, None)


def first_valid(df: DataFrame, key: str, order: Column, valid: Column) -> DataFrame:
    """The first valid row of each id; ids without one are absent."""
    return _pick(df.where(has_id(key)), [key], order, False, valid)


def last_valid(df: DataFrame, key: str, order: Column, valid: Column) -> DataFrame:
    return _pick(df.where(has_id(key)), [key], order, True, valid)


def keep_first(df: DataFrame, keys: dict[str, Column], order: Column) -> DataFrame:
    """The first row for each value of the (normalized) keys; null keys are equal to each other."""
    named = df.withColumns({f"key_{k}__": v for k, v in keys.items()})
    return _pick(named, [f"key_{k}__" for k in keys], order, False, None).select(*df.columns)


def normalized(*columns: str) -> dict[str, Column]:
    """Keys that compare trimmed and caseless."""
    return {c: tx.fold(tx.trim(F.col(c))) for c in columns}


def ordered_distinct(df: DataFrame, value: str, order: Column) -> DataFrame:
    """Distinct values with the ordinal of their first row."""
    return df.groupBy(value).agg(F.min(order).alias("first_at"))


def in_order(df: DataFrame, key: str, order: Column, value: Column, name: str = "items") -> DataFrame:
    """All values of each id as an array in order."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return df.where(has_id(key)).groupBy(key).agg(F.transform(rows, lambda r: r["v"]).alias(name))
