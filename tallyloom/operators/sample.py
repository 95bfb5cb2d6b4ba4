"""Seeded samples that do not depend on partitioning: rows ordered by a keyed hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _hash(seed: int, *keys: str):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def share_sample(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """``round(n * share)`` rows (half to even) without replacement: the first by a hash of seed and key."""
    n = int(df.agg(F.bround(F.count("*") * share).cast("bigint")).collect()[0][0])
    return n_sample(df, key, n, seed)


def n_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.withColumn("__h", _hash(seed, key)).orderBy("__h", key).limit(n).drop("__h")


def per_group_sample(df: DataFrame, group: str, key: str, k: int, seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """``k`` rows of every group, rows of ``exclude`` (by key) left out first."""
    pool = df.join(exclude.select(key).distinct(), key, "left_anti") if exclude is not None else df
    w = W.partitionBy(group).orderBy(_hash(seed, group, key), key)
    return pool.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def spot_check(df: DataFrame, key: str, n: int, seed: int | None = None) -> DataFrame:
    """``n`` rows to look at; without a seed another choice each time."""
    import random

    return n_sample(df, key, n, random.randrange(1 << 30) if seed is None else seed)
