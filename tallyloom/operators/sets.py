"""Set operations on keys and rows, and a cache keyed by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_keys(frames: list[DataFrame], key: str) -> DataFrame:
    """Distinct keys of all frames."""
    out = frames[0].select(key)
    for f in frames[1:]:
        out = out.unionByName(f.select(key))
    return out.distinct()


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def missing_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` has not; a null key of ``a`` counts as missing."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` without one for each equal row of ``b``."""
    return a.exceptAll(b)


def split(df: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """``part``: the first of ``parts`` whose condition holds, else ``rest``; every row is in one part."""
    out = F.lit("rest")
    for name, cond in reversed(list(parts.items())):
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(name)).otherwise(out)
    return df.withColumn("part", out)


def content_key(model: str, most: int, text: Column) -> Column:
    """Key of a computed value: model, length limit and text; null text counts as empty."""
    return F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(str(most)), F.coalesce(text, F.lit(""))), 256)


def cache_lookup(df: DataFrame, cache: DataFrame, key: Column, value: str) -> DataFrame:
    """``df`` with ``cache_key``, the cached ``value`` (null where there is none) and ``is_cached``."""
    keyed = df.withColumn("cache_key", key)
    got = cache.select(F.col("cache_key"), F.col(value), F.lit(True).alias("is_cached")).dropDuplicates(["cache_key"])
    return keyed.join(got, "cache_key", "left").withColumn("is_cached", F.coalesce("is_cached", F.lit(False)))
