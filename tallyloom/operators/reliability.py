"""Agreement between coders. Ratings are long: ``(variable, unit, coder, value)``, one per coder and unit; null = not rated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.joins import coder_pairs


def alpha(ratings: DataFrame, degenerate: str = "null") -> DataFrame:
    """Nominal Krippendorff alpha per variable for any number of coders; every value, ``na`` too, is a category.

    Without a pair: null. With one category only: null, or 1 if ``degenerate`` is ``one``. Counts per unit and value come
    first, so no pairs are listed.
    """
    n = ratings.where("value IS NOT NULL").groupBy("variable", "unit", "value").agg(F.count("*").cast("double").alias("n"))
    u = n.groupBy("variable", "unit").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq")).where("m > 1")
    seen = u.groupBy("variable").agg(F.count("*").alias("n_units"), F.sum("m").alias("t"), F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("d"))
    c = n.join(u.select("variable", "unit"), ["variable", "unit"], "left_semi").groupBy("variable", "value").agg(F.sum("n").alias("c"))
    cc = c.groupBy("variable").agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
    expected = (F.col("t") * F.col("t") - F.col("cc")) / (F.col("t") - 1)
    one = F.when(F.lit(degenerate == "one") & (F.col("d") == 0), F.lit(1.0))
    return seen.join(cc, "variable").select("variable", "n_units", F.when(expected > 0, 1 - F.col("d") / expected).otherwise(one).alias("alpha"))


def kappa(ratings: DataFrame) -> DataFrame:
    """Cohen's kappa per variable and pair of coders over the units both rated; fewer than two give null, all identical 1."""
    keyed = ratings.where("value IS NOT NULL").withColumn("__u", F.struct("variable", "unit"))
    p = coder_pairs(keyed.select("__u", "coder", "value"), "__u", "coder", "value").select(F.col("__u.variable").alias("variable"), "coder_a", "coder_b", "a", "b")
    g = ["variable", "coder_a", "coder_b"]
    tot = p.groupBy(*g).agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))
    ma, mb = p.groupBy(*g, F.col("a").alias("v")).agg(F.count("*").alias("na")), p.groupBy(*g, F.col("b").alias("v")).agg(F.count("*").alias("nb"))
    chance = ma.join(mb, [*g, "v"]).groupBy(*g).agg(F.sum(F.col("na") * F.col("nb")).alias("e"))
    j = tot.join(chance, g, "left").withColumn("po", F.col("same") / F.col("n")).withColumn("pe", F.coalesce("e", F.lit(0)) / (F.col("n") * F.col("n")))
    k = F.when(F.col("n") < 2, F.lit(None).cast("double")).when(F.col("pe") == 1, F.lit(1.0)).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return j.select(*g, "n", k.alias("kappa"))


def agreement(ratings: DataFrame) -> DataFrame:
    """``(variable, n_units, agreement)`` over the units that all coders of the variable rated; none gives null."""
    coders = ratings.groupBy("variable").agg(F.count_distinct("coder").alias("n_coders"))
    u = ratings.where("value IS NOT NULL").groupBy("variable", "unit").agg(F.count_distinct("coder").alias("k"), F.count_distinct("value").alias("v"))
    full = u.join(F.broadcast(coders), "variable").where("k = n_coders")
    return full.groupBy("variable").agg(F.count("*").alias("n_units"), F.avg((F.col("v") == 1).cast("double")).alias("agreement"))


def pair_agreement(ratings: DataFrame) -> DataFrame:
    """``(variable, coder_a, coder_b, n_units, agreement)`` per pair of coders over the units both rated."""
    keyed = ratings.where("value IS NOT NULL").withColumn("__u", F.struct("variable", "unit"))
    p = coder_pairs(keyed.select("__u", "coder", "value"), "__u", "coder", "value")
    return p.groupBy(F.col("__u.variable").alias("variable"), "coder_a", "coder_b").agg(F.count("*").alias("n_units"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"))


def missing_counts(ratings: DataFrame) -> DataFrame:
    """``na`` answers and missing ratings per variable and coder."""
    return ratings.groupBy("variable", "coder").agg(F.count("*").alias("n"), F.count_if(F.col("value") == "na").alias("n_na"), F.count_if(F.col("value").isNull()).alias("n_missing"))


MEASURES = {"alpha": alpha, "agreement": agreement, "kappa": kappa}


def report(ratings: DataFrame, measures: list[str]) -> dict[str, DataFrame]:
    """The named measures; new ones are added to MEASURES."""
    return {m: MEASURES[m](ratings) for m in measures}
