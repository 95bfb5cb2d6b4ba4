"""Deduplication by keys, with every tie-break explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column], null_keys: str = "group") -> DataFrame:
    """The first row per key in ``order`` (which must be total). ``null_keys`` is ``group`` (nulls are one key) or ``keep``.

    A window over the key, for orders that mix directions; each task keeps the first row of every key it holds before the
    shuffle. :func:`keep_best` does the same by one aggregate where the order is a struct.
    """
    rest = None
    if null_keys == "keep":
        is_null = F.col(keys[0]).isNull()
        rest, df = df.where(is_null), df.where(~is_null)
    w = W.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return out.unionByName(rest) if rest is not None else out


def keep_best(df: DataFrame, keys: list[str], rank: Column, last: bool = False) -> DataFrame:
    """The row with the least (``last``: greatest) ``rank`` struct per key, by a map-side combined aggregate."""
    pick = F.max_by if last else F.min_by
    names = df.columns
    one = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(pick(F.struct(*names), rank).alias("__row"))
    return one.select(*[F.col("__row")[c].alias(c) for c in names])


def naive_dedup(df: DataFrame, doi: str, title: str, preferred: Column, ord_col: str) -> DataFrame:
    """Two passes: one row per doi (preferred ones first), then one per title (with doi first, then preferred).

    The preference of rows without doi is unknown to the second pass and sorts last. All null titles are one title.
    """
    flagged = df.withColumn("__p", F.coalesce(preferred, F.lit(False)))
    first = keep_best(flagged.where(F.col(doi).isNotNull()), [doi], F.struct((~F.col("__p")).alias("a"), F.col(ord_col).alias("b")))
    rest = flagged.where(F.col(doi).isNull()).withColumn("__p", F.lit(None).cast("boolean"))
    both = first.unionByName(rest)
    rank = F.struct(F.col(doi).isNull().alias("a"), F.coalesce((~F.col("__p")).cast("int"), F.lit(2)).alias("b"), F.col(ord_col).alias("c"))
    return keep_best(both, [title], rank).drop("__p")


def assembly_dedup(df: DataFrame, doi: str, title: str, manual: Column, ord_col: str) -> DataFrame:
    """Two passes in which manual rows lose: one per doi, then one per title with doi first."""
    flagged = df.withColumn("__m", F.coalesce(manual, F.lit(False)))
    first = keep_best(flagged.where(F.col(doi).isNotNull()), [doi], F.struct(F.col("__m").alias("a"), F.col(ord_col).alias("b")))
    both = first.unionByName(flagged.where(F.col(doi).isNull()))
    return keep_best(both, [title], F.struct(F.col(doi).isNull().alias("a"), F.col("__m").alias("b"), F.col(ord_col).alias("c"))).drop("__m")


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    """``(key, n)`` of keys that occur more than once; null is no key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def fingerprint(df: DataFrame, order: str, text: str) -> DataFrame:
    """One row ``(n, sha256)`` over the texts in order.

    Every row gives a hash of its place and text; the fingerprint is the hash of the sums of their halves, so rows are
    neither sorted nor collected. Equal fingerprints mean equal texts in equal order.
    """
    h = F.sha2(F.concat_ws("\x1f", F.col(order).cast("string"), F.coalesce(F.col(text), F.lit("\x00"))), 256)
    parts = [F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(p), F.lit(0).cast("decimal(38,0)")).alias(f"s{i}") for i, p in enumerate(parts)])
    return sums.select("n", F.sha2(F.concat_ws(",", "n", "s0", "s1", "s2", "s3"), 256).alias("sha256"))
