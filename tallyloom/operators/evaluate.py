"""Scores of predicted labels against gold labels, all in long form. Undefined scores are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.vectors import jaccard, nearest


def aligned(gold: DataFrame, runs: DataFrame, item: str, run: list[str]) -> DataFrame:
    """Every gold item with every run: missing predictions are null, so the denominator is the gold set.

    ``gold`` has one row per item; the runs are few, their distinct names are broadcast by size.
    """
    names = runs.select(*run).distinct()
    return gold.crossJoin(F.broadcast(names)).join(runs, [item, *run], "left")


def compliance(rows: DataFrame, run: list[str], valid: Column) -> DataFrame:
    """``(run, n_gold, compliance)``: the share of valid predictions; an absent one counts as a failure."""
    return rows.groupBy(*run).agg(F.count("*").alias("n_gold"), F.avg(F.coalesce(valid, F.lit(False)).cast("double")).alias("compliance"))


def failure_rates(rows: DataFrame, run: list[str], checks: dict[str, Column]) -> DataFrame:
    """Share of rows that fail each check; checks are not exclusive, a null check counts as failed."""
    return rows.groupBy(*run).agg(*[F.avg((~F.coalesce(ok, F.lit(False))).cast("double")).alias(name) for name, ok in checks.items()])


def multilabel_scores(pairs: DataFrame, run: list[str], item: str, gold: str, pred: str) -> DataFrame:
    """Per class ``(run, label, tp, fp, fn, precision, recall, f1)`` from two label sets; rows with a null set are left out."""
    both = pairs.where(F.col(gold).isNotNull() & F.col(pred).isNotNull())
    long = both.select(*run, item, gold, pred, F.explode(F.array_union(gold, pred)).alias("label"))
    g, p = F.array_contains(gold, F.col("label")), F.array_contains(pred, F.col("label"))
    agg = long.groupBy(*run, "label").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    return agg.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn"))).withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def macro(scores: DataFrame, run: list[str]) -> DataFrame:
    """Means over the classes with a score."""
    return scores.groupBy(*run).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def binary_scores(pairs: DataFrame, run: list[str], gold: str, pred: str) -> DataFrame:
    """Scores of a 0/1 label over the pairs with both; here an undefined score is 0."""
    both = pairs.where(F.col(gold).isNotNull() & F.col(pred).isNotNull())
    a = both.groupBy(*run).agg(
        F.count_if((F.col(gold) == 1) & (F.col(pred) == 1)).alias("tp"), F.count_if((F.col(gold) == 0) & (F.col(pred) == 1)).alias("fp"), F.count_if((F.col(gold) == 1) & (F.col(pred) == 0)).alias("fn")
    )
    z = lambda n, d: F.coalesce(F.try_divide(n, d), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return a.withColumn("precision", z(tp, tp + fp)).withColumn("recall", z(tp, tp + fn)).withColumn("f1", z(2 * tp, 2 * tp + fp + fn))


BUCKETS = [0.0, 1 / 3, 0.5, 1.0]


def jaccard_table(pairs: DataFrame, run: list[str], gold: str, pred: str) -> DataFrame:
    """``(run, n, mean_jaccard, n_0, n_third, n_half, n_1)``: mean and nearest bucket of the per-item overlap."""
    both = pairs.where(F.col(gold).isNotNull() & F.col(pred).isNotNull()).withColumn("__j", jaccard(F.col(gold), F.col(pred)))
    b = nearest(F.col("__j"), BUCKETS)
    return both.groupBy(*run).agg(F.count("*").alias("n"), F.avg("__j").alias("mean_jaccard"), *[F.count_if(b == v).alias(n) for n, v in zip(("n_0", "n_third", "n_half", "n_1"), BUCKETS)])


def confusion(pairs: DataFrame, gold: str, pred: str, classes: list[str]) -> DataFrame:
    """``(gold, pred, n)`` over the whole grid of classes, zeros included."""
    n = pairs.where(F.col(gold).isin(classes) & F.col(pred).isin(classes)).groupBy(gold, pred).agg(F.count("*").alias("n"))
    one = pairs.sparkSession.createDataFrame([(c,) for c in classes], "c string")
    grid = one.select(F.col("c").alias(gold)).crossJoin(one.select(F.col("c").alias(pred)))
    return grid.join(n, [gold, pred], "left").select(gold, pred, F.coalesce("n", F.lit(0)).alias("n"))


def best_run(scores: DataFrame, by: list[str], score: str, tie: str, digits: int | None = None) -> DataFrame:
    """The best row per group by ``score`` (rounded half-even first if ``digits`` is given), of equals the least ``tie``; groups without a score give none."""
    s = F.bround(score, digits) if digits is not None else F.col(score)
    w = W.partitionBy(*by).orderBy(F.desc(s), tie)
    return scores.where(F.col(score).isNotNull() & ~F.isnan(score)).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def gated(scores: DataFrame, rates: DataFrame, run: list[str], columns: list[str], least: float = 0.8) -> DataFrame:
    """Scores of runs under the compliance gate set to null; the rows stay."""
    j = scores.join(rates.select(*run, "compliance"), run, "left")
    ok = F.coalesce(F.col("compliance") >= least, F.lit(False))
    for c in columns:
        j = j.withColumn(c, F.when(ok, F.col(c)))
    return j
