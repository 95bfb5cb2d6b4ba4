"""Joins that the pipelines need beyond plain equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators.dedup import keep_best


def pooled_union(left: DataFrame, right: DataFrame, key: str, ord_col: str, names: tuple[str, str] = ("s1", "s2")) -> DataFrame:
    """Full outer union of two selections by ``key`` with ``source`` = both, ``<name>_only``; the last row per key and side counts.

    The columns are those of ``left``, its row where there is one. Null keys are left out.
    """
    a = keep_best(left.where(F.col(key).isNotNull()), [key], F.col(ord_col), last=True)
    b = keep_best(right.where(F.col(key).isNotNull()), [key], F.col(ord_col), last=True)
    la, lb = a.select(F.col(key).alias("__k"), F.struct(*a.columns).alias("a")), b.select(F.col(key).alias("__k"), F.struct(*a.columns).alias("b"))
    j = la.join(lb, "__k", "full_outer")
    source = F.when(F.col("a").isNull(), f"{names[1]}_only").when(F.col("b").isNull(), f"{names[0]}_only").otherwise("both")
    return j.withColumn("source", source).withColumn("row", F.coalesce("a", "b")).select("row.*", "source")


def gaps(df: DataFrame, group: str, number: str) -> DataFrame:
    """``(group, number)`` of the numbers from 1 to the greatest of each group that are not there."""
    top = df.groupBy(group).agg(F.max(number).alias("__top")).where(F.col("__top") >= 1)
    every = top.select(group, F.explode(F.sequence(F.lit(1), F.col("__top").cast("int"))).alias(number))
    return every.join(df.select(group, number).distinct(), [group, number], "left_anti")


def coverage(found: DataFrame, misses: DataFrame, group: str, number: str) -> DataFrame:
    """Missing numbers with the reason of their latest miss and whether they lie in the tail after the last found number."""
    top = found.groupBy(group).agg(F.max(number).alias("top"))
    every = misses.select(group, number).unionByName(found.select(group, number)).groupBy(group).agg(F.max(number).alias("last"))
    wanted = every.select(group, F.explode(F.sequence(F.lit(1), F.greatest("last", F.lit(1)).cast("int"))).alias(number))
    missing = wanted.join(found.select(group, number).distinct(), [group, number], "left_anti")
    out = missing.join(top, group, "left").join(misses, [group, number], "left")
    return out.withColumn("place", F.when(F.col(number) > F.coalesce("top", F.lit(0)), "tail").otherwise("gap")).drop("top")


def ranked_parents(children: DataFrame, parents: DataFrame, stems: str, date: str, least: float) -> DataFrame:
    """Best parent of every child: not later, with at least ``least`` of the child's stems; most overlap, then Jaccard, then latest, then smallest id.

    ``id`` and an array of distinct ``stems`` on both sides. A parent may lack at most ``cn - ceil(least * cn)`` of a child's
    ``cn`` stems, so of any one more than that it has at least one: only that many stems of a child are joined, the rarest
    among the parents, and the pairs found are compared in full. Stems that most titles share are never joined on.
    """
    c = children.select(F.col("id").alias("child"), F.col(date).alias("cd"), F.col(stems).alias("cs"), F.size(stems).alias("cn")).where("cn > 0")
    p = parents.select(F.col("id").alias("parent"), F.col(date).alias("pd"), F.col(stems).alias("ps"), F.explode(stems).alias("stem"))
    often = p.groupBy("stem").agg(F.count("*").alias("n"))
    own = c.select("child", "cn", F.explode("cs").alias("stem")).join(often, "stem", "left")
    rare = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "stem"))), lambda x: x["stem"])
    need = F.ceil(F.lit(least) * F.col("cn") - F.lit(1e-9))
    keys = own.groupBy("child", "cn").agg(rare.alias("r")).select("child", F.explode(F.slice("r", F.lit(1), (F.col("cn") - need + 1).cast("int"))).alias("stem"))
    met = keys.join(p.select("parent", "stem"), "stem").select("child", "parent").distinct()
    full = met.join(c, "child").join(parents.select(F.col("id").alias("parent"), F.col(date).alias("pd"), F.col(stems).alias("ps")), "parent").where("pd <= cd")
    common = F.size(F.array_intersect("cs", "ps"))
    score = full.select("child", "parent", "pd", (common / F.col("cn")).alias("overlap"), (common / (F.col("cn") + F.size("ps") - common)).alias("jaccard")).where(F.col("overlap") >= least)
    w = W.partitionBy("child").orderBy(F.desc("overlap"), F.desc("jaccard"), F.desc("pd"), "parent")
    return score.withColumn("r", F.row_number().over(w)).where("r = 1").select("child", "parent", "overlap", "jaccard")


def in_all(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that every group has, and the keys that miss some, with the number of groups that have them."""
    n = df.agg(F.count_distinct(group).alias("n_groups"))
    per = df.groupBy(key).agg(F.count_distinct(group).alias("n_in"))
    return per.join(F.broadcast(n)).withColumn("in_all", F.col("n_in") == F.col("n_groups"))


def coder_pairs(df: DataFrame, item: str, coder: str, value: str) -> DataFrame:
    """Pairs of coders per item, the smaller name first: ``(item, coder_a, coder_b, a, b)``; one rating per coder and item expected."""
    left = df.select(item, F.col(coder).alias("coder_a"), F.col(value).alias("a"))
    right = df.select(item, F.col(coder).alias("coder_b"), F.col(value).alias("b"))
    return left.join(right, item).where("coder_a < coder_b")


def orphans(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def only_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_semi")


def lookup(df: DataFrame, table: DataFrame, keys: list[str], small: bool = False) -> DataFrame:
    """Left join; ``small`` asserts that the table is of bounded size and may be broadcast."""
    return df.join(F.broadcast(table) if small else table, keys, "left")
