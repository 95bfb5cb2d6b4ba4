"""Duplicates hidden by formatting differences, found by progressive partition refinement.

The bare values are made once and written to the checkpoint. Level 0 groups by what costs nothing more: the number of empty
fields and the stripped length of the values together. Level 1 splits the classes with several members by a letter
histogram. Neither depends on which column holds which value. Level 2 compares the ordered values themselves inside what is
left, so the result is exact. Counts are pre-aggregated on the map side and rows meet their group by a salted join (level 0
by a broadcast, where its classes are few), so one group may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.runtime import cut_lineage, salted_join

#: Ways to cite a doi, removed where what follows looks like one.
CITED = r"^[\s\p{Z}\p{C}]*(?:(?:https?://)?(?:dx\.)?doi\.[a-z]+/|doi[\s\p{Z}]*:?[\s\p{Z}]*|info:doi/)(?=10\.[0-9])"
IGNORED = r"[^\p{L}\p{N}\p{M}]+"
LETTERS = "etaoinsrhl012"
#: Classes of level 0 up to which their table is broadcast (a class is under 50 bytes); beyond, a salted join.
BROADCAST_CLASSES = 500_000


def bare(c: Column) -> Column:
    """The value without blanks, case, punctuation and the way a doi is cited; null stays null."""
    return F.regexp_replace(F.regexp_replace(F.lower(c.cast("string")), CITED, ""), IGNORED, "")


def _histogram(joined: Column) -> Column:
    """64 bits of how often each of some letters and digits occurs."""
    return F.xxhash64(*[F.octet_length(joined) - F.octet_length(F.replace(joined, F.lit(ch), F.lit(""))) for ch in LETTERS])


def copy_groups(df: DataFrame, ord_col: str, columns: list[str], identifying: list[str]) -> DataFrame:
    """Members of groups of copies: ``(first_ord, ord, n_records)``, the first record of a group included.

    Two records are copies if their ``columns`` hold the same values apart from formatting, in any column order. Null
    equals only null; an empty value is not null. A record without any visible value in ``identifying`` is never a copy.
    ``ord_col`` is unique; rows with a null key are left out. Records without copies give no row. Extra columns are not
    read; an empty table gives an empty result.
    """
    vals = [f"__v{i}" for i in range(len(columns))]
    base = df.where(F.col(ord_col).isNotNull()).select(F.col(ord_col).alias("ord"), *[bare(F.col(c)).alias(v) for c, v in zip(columns, vals)])
    some = F.lit(False)
    for c, v in zip(columns, vals):
        if c in identifying:
            some = some | (F.coalesce(F.length(v), F.lit(0)) > 0)
    # the values in an order that does not depend on the columns, null marked apart from empty
    marked = F.array_sort(F.array(*[F.coalesce(F.concat(F.lit("+"), F.col(v)), F.lit("-")) for v in vals]))
    n_null = sum((F.isnull(v).cast("int") for v in vals), F.lit(0))
    length = sum((F.coalesce(F.length(v), F.lit(0)) for v in vals), F.lit(0))
    base = cut_lineage(base.where(some).select("ord", n_null.alias("nulls"), length.alias("len"), F.array_join(marked, "\x1f").alias("key")))
    per0 = base.groupBy("nulls", "len").agg(F.count("*").alias("n0"))
    c0 = per0.where("n0 > 1").persist()
    n_classes, total = c0.agg(F.count("*"), F.coalesce(F.sum("n0"), F.lit(0))).collect()[0]
    if n_classes <= BROADCAST_CLASSES:
        level1 = base.join(F.broadcast(c0), ["nulls", "len"])
    else:
        level1 = salted_join(base, c0, ["nulls", "len"], "n0", "ord", total)
    level1 = level1.select("ord", F.xxhash64("nulls", "len", _histogram(F.col("key"))).alias("k1"), "key")
    c1 = level1.groupBy("k1").agg(F.count("*").alias("n1")).where("n1 > 1")
    level2 = cut_lineage(salted_join(level1, c1, ["k1"], "n1", "ord", total).select("ord", "k1", "key"))
    c0.unpersist()
    groups = level2.groupBy("k1", "key").agg(F.min("ord").alias("first_ord"), F.count("*").alias("n_records")).where("n_records > 1")
    return salted_join(level2, groups, ["k1", "key"], "n_records", "ord", total).select("first_ord", "ord", "n_records")


def find_copies(df: DataFrame, ord_col: str, columns: list[str], identifying: list[str]) -> DataFrame:
    """One row ``(first_ord, copy_ord)`` per copy: the smallest key of its group and its own."""
    return copy_groups(df, ord_col, columns, identifying).where("ord > first_ord").select("first_ord", F.col("ord").alias("copy_ord"))


def collapse_copies(df: DataFrame, ord_col: str, columns: list[str], identifying: list[str]) -> DataFrame:
    """One record per group (the one with the smallest key, as it stands) with ``n_copies``, the number of its copies.

    Records without copies, and rows with a null key, stay with 0 copies. A column ``n_copies`` of ``df`` is replaced.
    """
    found = copy_groups(df, ord_col, columns, identifying)
    members = found.select(F.col("first_ord").alias("__first"), F.col("ord").alias("__ord"), F.col("n_records").alias("__n"))
    joined = df.join(members, df[ord_col] == members["__ord"], "left")
    kept = joined.where(F.col("__first").isNull() | (F.col("__first") == F.col("__ord")))
    return kept.withColumn("n_copies", F.coalesce(F.col("__n") - 1, F.lit(0))).drop("__first", "__ord", "__n")
