"""Runs, sliding counts and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_state(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row per key by ``order``, as one map-side combined aggregate."""
    from tallyloom.operators.dedup import keep_best

    return keep_best(log, keys, F.struct(*order), last=True)


def miss_runs(df: DataFrame, group: str, number: str, status: str, hit: str, error: str) -> DataFrame:
    """Runs of misses and of errors in number order.

    An error leaves the run of misses as it is; any answer ends the run of errors; only a hit ends the run of misses.
    """
    w = W.partitionBy(group).orderBy(number).rowsBetween(W.unboundedPreceding, W.currentRow)
    is_hit, is_error = F.col(status) == hit, F.col(status) == error
    a = df.withColumn("__mi", F.sum(is_hit.cast("int")).over(w)).withColumn("__ei", F.sum((~is_error).cast("int")).over(w))
    mw = W.partitionBy(group, "__mi").orderBy(number).rowsBetween(W.unboundedPreceding, W.currentRow)
    ew = W.partitionBy(group, "__ei").orderBy(number).rowsBetween(W.unboundedPreceding, W.currentRow)
    a = a.withColumn("miss_run", F.sum((~is_hit & ~is_error).cast("int")).over(mw)).withColumn("error_run", F.sum(is_error.cast("int")).over(ew))
    return a.drop("__mi", "__ei")


def sliding_count(df: DataFrame, keys: list[str], ts: str, seconds: int, name: str) -> DataFrame:
    """Rows of the same key in the ``seconds`` up to and including each row; the boundary counts."""
    sec = F.unix_micros(F.col(ts).cast("timestamp"))
    w = W.partitionBy(*keys).orderBy("__us").rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("__us", sec).withColumn(name, F.count("*").over(w)).drop("__us")


def running_count(df: DataFrame, group: list[str], order: list[str], cond, name: str) -> DataFrame:
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(name, F.sum(cond.cast("int")).over(w))


def first_open(df: DataFrame, pos: str, decision: str) -> DataFrame:
    """One row ``(resume_at)``: the least position without a decision."""
    return df.agg(F.min(F.when(F.col(decision).isNull(), F.col(pos))).alias("resume_at"))


def top_per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def numbered(df: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    """Collision suffix: 1, 2, … within the key."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def first_in_order(df: DataFrame, order: list, k: int) -> DataFrame:
    """The first ``k`` rows in ``order`` (which must be total) with their ``place`` from 1: a bounded sort, of which one task numbers ``k`` rows."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn("place", F.row_number().over(W.orderBy(*order)))


def category_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """Dense codes from 0 in order of the values, null as -1.

    The distinct values are counted first; they are the categories, so they are few beside the rows. Only they are sorted.
    """
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    codes = values.withColumn(name, F.row_number().over(W.orderBy(column)) - 1)
    return df.join(codes, column, "left").withColumn(name, F.coalesce(name, F.lit(-1)))
