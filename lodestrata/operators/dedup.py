"""One row per key, by rule; conflicts told apart. All are aggregations with a partial step before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def pick(df: DataFrame, keys: list[str], order: list[Column], largest: bool = False) -> DataFrame:
    """The row of each key that comes first in `order` (nulls first), or last if `largest`; ties must be broken by `order`."""
    rest = [c for c in df.columns if c not in keys]
    best = (F.max_by if largest else F.min_by)(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *(F.col("_row")[c].alias(c) for c in rest))


def conflicts(df: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """Keys whose rows differ in content, with the number of different contents; null is a content of its own."""
    marked = df.select(*keys, F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in content)).alias("_h"))
    return marked.groupBy(*keys).agg(F.count_distinct("_h").alias("n_contents")).filter("n_contents > 1")


def keep_first(df: DataFrame, keys: list[str], order: list[Column], limit: int | None = None) -> DataFrame:
    """First row of each key in `order`, and of these the first `limit` in that order, with position from 1."""
    first = pick(df, keys, order)
    if limit is None:
        return first
    top = first.orderBy(*order).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)))  # over `limit` rows


def sets_of(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The sorted distinct values of each key as JSON text, which keeps commas within values."""
    return df.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_set(value))).alias(name))


def folded(df: DataFrame, key: str, stable: list[str], nested: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Join rows folded to one row per key with the distinct nested rows, and the keys whose stable fields differ."""
    bad = conflicts(df, [key], stable)
    rows = df.groupBy(key).agg(*(F.min(c).alias(c) for c in stable), F.array_sort(F.collect_set(F.struct(*nested))).alias(name))
    return rows.join(bad.select(key), key, "left_anti"), bad
