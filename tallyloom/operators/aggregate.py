"""Counts, shares, histograms, crosstabs and marginal means."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    """``(keys, n)``; rows with a null key are left out."""
    ok = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(ok).groupBy(*keys).agg(F.count("*").alias("n"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])


def shares(df: DataFrame, key: str, total_name: str = "total") -> DataFrame:
    """``(key, n, percent)`` with a total row; one pass by a rollup."""
    named = df.select(F.coalesce(F.col(key).cast("string"), F.lit("(none)")).alias(key))
    r = named.rollup(key).agg(F.count("*").alias("n"))
    every = df.agg(F.count("*").alias("__all"))
    return r.join(F.broadcast(every)).select(F.coalesce(F.col(key), F.lit(total_name)).alias(key), "n", F.try_divide(F.col("n") * 100.0, F.col("__all")).alias("percent"))


def crosstab_margins(df: DataFrame, row: str, col: str, col_values: list[str]) -> DataFrame:
    """Counts by row with one column per value, and the margins ``All``; null rows are left out."""
    base = df.where(F.col(row).isNotNull() & F.col(col).isin(col_values))
    cells = [F.count_if(F.col(col) == v).alias(v) for v in col_values]
    r = base.rollup(row).agg(*cells, F.count("*").alias("All"))
    return r.withColumn(row, F.coalesce(F.col(row).cast("string"), F.lit("All")))


def pivot_unique(df: DataFrame, row: str, col: str, value: str, col_values: list[str]) -> DataFrame:
    """Long to wide; a cell with two values raises when it is computed."""
    cell = lambda v: F.when(F.count_if(F.col(col) == v) > 1, F.raise_error(F.lit(f"two values for {v}"))).otherwise(F.max(F.when(F.col(col) == v, F.col(value))))
    return df.groupBy(row).agg(*[cell(v).alias(v) for v in col_values])


def describe(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """``n, min, max, mean, median`` (exact) of a number; nulls and NaN are left out."""
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return df.groupBy(*keys).agg(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``(bin, low, high, n)`` of equal bins between the least and greatest value, the last bin closed; empty bins are there with 0."""
    x = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    ends = x.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    at = F.when(F.col("a") == F.col("b"), F.lit(1)).otherwise(F.least(F.floor((F.col("x") - F.col("a")) / (F.col("b") - F.col("a")) * bins) + 1, F.lit(bins)))
    n = x.join(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.where(F.col("a").isNotNull()).select("a", "b", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    step = (F.col("b") - F.col("a")) / bins
    return grid.join(n, "bin", "left").select("bin", (F.col("a") + step * (F.col("bin") - 1)).alias("low"), (F.col("a") + step * F.col("bin")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def reindexed(counts: DataFrame, key: str, values: list[str], n: str = "n") -> DataFrame:
    """Counts in a fixed order of categories, missing ones 0."""
    dim = counts.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values)], f"place int, {key} string")
    return dim.join(counts, key, "left").select("place", key, F.coalesce(n, F.lit(0)).alias(n))


def marginal_means(df: DataFrame, dims: list[str], measures: list[str]) -> DataFrame:
    """``(dim, value, means)``: the mean over all rows with that value of that dimension, in one pass over grouping sets.

    Nulls and NaN in a measure are skipped.
    """
    clean = df.select(*[F.col(d).cast("string").alias(d) for d in dims], *[F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")).alias(m) for m in measures])
    sets = clean.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(*[F.avg(m).alias(m) for m in measures], *[F.grouping(d).alias(f"__g_{d}") for d in dims])
    name = F.coalesce(*[F.when(F.col(f"__g_{d}") == 0, F.lit(d)) for d in dims])
    value = F.coalesce(*[F.when(F.col(f"__g_{d}") == 0, F.col(d)) for d in dims])
    return sets.select(name.alias("dim"), value.alias("value"), *measures)


def top_values(df: DataFrame, items: Column, pos: str, k: int) -> DataFrame:
    """The ``k`` most frequent elements of an array column; of equals the one seen first by ``pos``."""
    e = df.select(F.col(pos).alias("__p"), F.posexplode(items).alias("__i", "item"))
    c = e.groupBy("item").agg(F.count("*").alias("n"), F.min(F.struct("__p", "__i")).alias("__first"))
    return c.orderBy(F.desc("n"), "__first").limit(k).select("item", "n")


def _lost_tokens(df: DataFrame, key: str, base: Column, other: Column, tokens) -> DataFrame:
    """``(key, token, a, lost)``: how often each token stands in ``base``, and how much less often in ``other``; one pass."""
    both = F.concat(F.transform(tokens(base), lambda x: F.struct(x.alias("t"), F.lit(1).alias("a"), F.lit(0).alias("b"))), F.transform(F.coalesce(tokens(other), F.array().cast("array<string>")), lambda x: F.struct(x.alias("t"), F.lit(0).alias("a"), F.lit(1).alias("b"))))
    counts = df.select(F.col(key), F.explode(both).alias("x")).groupBy(key, F.col("x.t").alias("token")).agg(F.sum("x.a").alias("a"), F.sum("x.b").alias("b"))
    return counts.select(key, "token", "a", F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("lost"))


def token_loss(df: DataFrame, key: str, base: Column, other: Column, tokens) -> DataFrame:
    """``(key, n_base, n_lost, loss)``: tokens of ``base`` that ``other`` has less often, over all tokens of ``base`` (at least 1)."""
    agg = _lost_tokens(df, key, base, other, tokens).groupBy(key).agg(F.sum("a").alias("n_base"), F.sum("lost").alias("n_lost"))
    out = df.select(key).distinct().join(agg, key, "left").select(key, F.coalesce("n_base", F.lit(0)).alias("n_base"), F.coalesce("n_lost", F.lit(0)).alias("n_lost"))
    return out.withColumn("loss", F.col("n_lost") / F.greatest("n_base", F.lit(1)))


def missing_words(df: DataFrame, key: str, base: Column, other: Column, tokens, k: int = 8) -> DataFrame:
    """``(word, n)``: the ``k`` tokens of ``base`` that ``other`` lacks most often, of equals the first by text."""
    lost = _lost_tokens(df, key, base, other, tokens).where("lost > 0").groupBy(F.col("token").alias("word")).agg(F.sum("lost").alias("n"))
    return lost.orderBy(F.desc("n"), "word").limit(k)
