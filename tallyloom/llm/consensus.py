"""Consensus of annotators who disagree: a variational confusion model fitted by group-bys.

Every item has a hidden class; every annotator has, for each class, a row of a confusion matrix with a Dirichlet prior. The
mean-field update alternates between the items (expected log class weight plus expected log confusion of each label, by a
window over the item) and the annotators (expected label counts, by one group-by with map-side combine that gives the class
counts as well). Expected logs are differences of digamma values of these counts. Rounds go on until the expected confusion
no longer changes. Labels are pre-aggregated to one row per item, annotator and label first, so an item or annotator with
any share of the rows costs no more than its distinct labels.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tallyloom.runtime import cut_lineage, salted_join

#: Confusion rows up to which the annotator table is broadcast (a row is under 300 bytes); beyond, a salted shuffle join.
BROADCAST_ROWS = 200_000
#: Rows of one cached partition, about.
PART_ROWS = 1_000_000


def digamma(x: np.ndarray) -> np.ndarray:
    """Digamma for x > 0: recurrence up to x + 6, then the asymptotic series (error below 1e-9)."""
    shift = sum(1.0 / (x + i) for i in range(6))
    y = x + 6.0
    y2 = 1.0 / (y * y)
    return np.log(y) - 0.5 / y - y2 * (1 / 12 - y2 * (1 / 120 - y2 * (1 / 252 - y2 * (1 / 240 - y2 / 132)))) - shift


def beta_interval(mean: float, var: float, mass: float = 0.95) -> tuple[float, float]:
    """The middle ``mass`` of the beta distribution with this mean and variance, by its density over a fine grid of log odds."""
    n = mean * (1 - mean) / var - 1
    a, b = mean * n, (1 - mean) * n
    # wide enough for either tail: the log odds of a beta fall off like exp(a x) and exp(-b x)
    x = np.linspace(-40 / min(a, 1.0) - 10, 40 / min(b, 1.0) + 10, 20001)
    centre, sd = np.log(a / b), np.sqrt(1 / a + 1 / b)
    x = np.unique(np.concatenate([x, np.linspace(centre - 12 * sd, centre + 12 * sd, 20001)]))
    log_density = -a * np.log1p(np.exp(-x)) - b * (x + np.log1p(np.exp(-x)))
    d = np.exp(log_density - log_density.max())
    cum = np.r_[0, np.cumsum((d[1:] + d[:-1]) / 2 * np.diff(x))]
    low, high = np.interp(np.array([1 - mass, 1 + mass]) / 2 * cum[-1], cum, x)
    return float(1 / (1 + np.exp(-low))), float(1 / (1 + np.exp(-high)))


class Consensus(NamedTuple):
    """items and coders (see :func:`fit_consensus`), the rounds it took, and the last change of the expected confusion."""

    items: DataFrame
    coders: DataFrame
    rounds: int
    change: float


def tally(labels: DataFrame) -> DataFrame:
    """``(variable, item, coder, label, n)``: distinct labels with their numbers; rows with a null in any of the four are unusable."""
    cols = ["variable", "item", "coder", "label"]
    usable = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    return labels.where(usable).groupBy(*cols).agg(F.count("*").alias("n"))


def _confusion(stats: pd.DataFrame, classes: dict[str, list[str]], right: float, wrong: float):
    """Per coder of ``stats`` (variable, coder, y, c): (variable, coder, expected counts, Dirichlet rows), classes x labels."""
    for (v, coder), g in stats.groupby(["variable", "coder"], sort=True):
        k = len(classes[v])
        counts = np.zeros((k, k))
        for y, c in zip(g["y"], g["c"]):
            counts[:, int(y)] += np.asarray(c, float)[:k]
        yield v, coder, counts, counts + np.where(np.eye(k, dtype=bool), right, wrong)


def _messages(stats: pd.DataFrame, classes: dict[str, list[str]], weights: dict[str, np.ndarray], right: float, wrong: float) -> pd.DataFrame:
    """``(variable, coder, y, e, p)``: what a label says for every class, and the expected confusion of every class with it."""
    out = []
    for v, coder, _, a in _confusion(stats, classes, right, wrong):
        e, p = digamma(a) - digamma(a.sum(axis=1, keepdims=True)), a / a.sum(axis=1, keepdims=True)
        out += [(v, coder, y, e[:, y].tolist(), p[:, y].tolist()) for y in range(len(a))]
    return pd.DataFrame(out, columns=["variable", "coder", "y", "e", "p"])


def _quality(stats: pd.DataFrame, classes: dict[str, list[str]], weights: dict[str, np.ndarray], right: float, wrong: float) -> pd.DataFrame:
    """``(variable, coder, n_labels, reliability, low, high)``: the diagonal, its rows combined by the weights of the classes."""
    out = []
    for v, coder, counts, a in _confusion(stats, classes, right, wrong):
        w, total = weights[v] / weights[v].sum(), a.sum(axis=1)
        m = np.diag(a) / total
        mean, var = float(w @ m), float((w * w) @ (m * (1 - m) / (total + 1)))
        out.append((v, coder, int(round(counts.sum())), mean, *beta_interval(mean, var)))
    return pd.DataFrame(out, columns=["variable", "coder", "n_labels", "reliability", "low", "high"])


MESSAGES = "variable string, coder string, y int, e array<double>, p array<double>"
QUALITY = "variable string, coder string, n_labels bigint, reliability double, low double, high double"


def fit_consensus(
    labels: DataFrame, classes: dict[str, list[str]], tolerance: float = 1e-3, rounds: int = 500, prior_right: float = 2.0, prior_wrong: float = 0.5, prior_class: float = 1.0, broadcast_rows: int = BROADCAST_ROWS
) -> Consensus:
    """The fitted model.

    ``labels`` has ``variable, item, coder, label``; ``classes`` the labels of each variable. Labels that are no class of
    their variable, and rows with nulls, are left out. A label a coder gave to an item more than once counts that often.
    Rounds end when no entry of any expected confusion matrix moves by ``tolerance`` or more; after ``rounds`` of them the
    fit is given as it is, with its last change.

    items: ``(variable, item, label, confidence, n_coders, n_labels)``, the most probable class (of equals the first in
    ``classes``). coders: ``(variable, coder, n_labels, reliability, low, high)``: the expected share of right labels, that is
    the diagonal of the confusion combined by the weights of the classes, with a 95 % posterior interval (mean and variance of
    the independent Dirichlet rows, taken as a beta distribution). Empty input gives empty results. Extra columns are ignored.

    The table of confusion rows goes through the driver and a broadcast up to ``broadcast_rows`` rows; a larger one stays
    distributed, is cut by checkpoints and met by a salted join. Both give the same result.
    """
    spark = labels.sparkSession
    width = max(len(c) for c in classes.values())
    index = spark.createDataFrame([(v, c, i, len(cs)) for v, cs in classes.items() for i, c in enumerate(cs)], "variable string, label string, y int, n_classes int")
    t = tally(labels).join(F.broadcast(index), ["variable", "label"]).select("variable", "item", "coder", "y", "n_classes", F.col("n").cast("double").alias("n"))
    base = cut_lineage(t)
    n_coders = base.groupBy("variable", "coder", "n_classes").agg(F.count("*").alias("r")).agg(F.coalesce(F.sum("n_classes"), F.lit(0)).alias("grid"), F.coalesce(F.sum("r"), F.lit(0)).alias("rows")).collect()[0]
    small, n_rows = n_coders["grid"] <= broadcast_rows, n_coders["rows"]
    per_row = None if small else cut_lineage(base.groupBy("variable", "coder", "y").agg(F.count("*").alias("__rows")))
    of_item = W.partitionBy("variable", "item")
    # shuffled and sorted once: the cached partitions keep their order, so no round moves a label again; a lost one is made
    # anew from the checkpoint
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // PART_ROWS))
    t = base.repartition(parts, "variable", "item").withColumn("share", 1.0 / F.count("*").over(of_item)).persist(StorageLevel.MEMORY_AND_DISK)
    ks, width_of = list(range(width)), F.col("n_classes")

    def normalised(df: DataFrame) -> DataFrame:
        """``q`` = ``w`` divided by its sum; one array column per step keeps the expressions from multiplying."""
        z = df.withColumn("__z", F.aggregate("w", F.lit(0.0), lambda a, b: a + b))
        return z.select(*t.columns, F.transform("w", lambda x: x / F.col("__z")).alias("q"))

    def gather(resp: DataFrame):
        """Expected label counts (variable, coder, y, c) and the class weights of each variable, from one pass over the labels."""
        sums = [F.sum(F.coalesce(x * F.get("q", F.lit(k)), F.lit(0.0))) for x in (F.col("n"), F.col("share")) for k in ks]
        both = resp.groupBy("variable", "coder", "y").agg(F.array(*sums[:width]).alias("c"), F.array(*sums[width:]).alias("m"))
        if small:
            both = both.toPandas()
            tot = {v: np.sum(g["m"].tolist(), axis=0) for v, g in both.groupby("variable")}
        else:
            both = cut_lineage(both)
            tot = {r["variable"]: np.array(r["m"]) for r in both.groupBy("variable").agg(F.array(*[F.sum(F.get("m", F.lit(k))) for k in ks]).alias("m")).collect()}
        return both, {v: m[: len(classes[v])] + prior_class for v, m in tot.items()}

    def per_coder(stats, make, weights, schema: str):
        """``make`` for every coder: a frame of the driver where the table is small, else distributed."""
        if small:
            return make(stats, classes, weights, prior_right, prior_wrong)
        return cut_lineage(stats.groupBy("variable", "coder").applyInPandas(lambda g: make(g, classes, weights, prior_right, prior_wrong), schema))

    def change(old, new) -> float:
        if small:
            pairs = zip(old["p"], new["p"])
            return max((float(np.abs(np.subtract(a, b)).max()) for a, b in pairs), default=0.0)
        both = old.select("variable", "coder", "y", F.col("p").alias("o")).join(new, ["variable", "coder", "y"])
        return both.agg(F.coalesce(F.max(F.array_max(F.zip_with("o", "p", lambda a, b: F.abs(a - b)))), F.lit(0.0))).collect()[0][0]

    def items_step(msg, weights: dict[str, np.ndarray]) -> DataFrame:
        prior = pa.table({"variable": pa.array(weights, pa.string()), "p": pa.array([digamma(m) - digamma(m.sum()) for m in weights.values()], pa.list_(pa.float64()))})
        prior = spark.createDataFrame(prior)
        if small:
            rows = pa.table({"variable": pa.array(msg["variable"], pa.string()), "coder": pa.array(msg["coder"], pa.string()), "y": pa.array(msg["y"], pa.int32()), "e": pa.array(msg["e"], pa.list_(pa.float64()))})
            j = t.join(F.broadcast(spark.createDataFrame(rows)), ["variable", "coder", "y"])
        else:
            rows = msg.select("variable", "coder", "y", "e").join(per_row, ["variable", "coder", "y"])
            j = salted_join(t, rows, ["variable", "coder", "y"], "__rows", "item", n_rows)
        j = j.join(F.broadcast(prior), "variable")
        sums = [F.sum(F.col("n") * F.get("e", F.lit(k))).over(of_item) for k in ks]
        j = j.select(*t.columns, F.zip_with(F.slice(F.array(*sums), 1, width_of), F.slice("p", 1, width_of), lambda a, b: a + b).alias("s"))
        j = j.withColumn("__m", F.array_max("s"))
        return normalised(j.withColumn("w", F.transform("s", lambda x: F.exp(x - F.col("__m")))))

    # start: share of the item's labels, smoothed
    votes = [F.sum(F.when(F.col("y") == k, F.col("n")).otherwise(0.0)).over(of_item) for k in ks]
    start = t.select(*t.columns, F.array(*votes).alias("v"))
    resp = normalised(start.withColumn("w", F.transform("v", lambda x, k: F.when(k < width_of, x + 0.1).otherwise(0.0))))
    stats, weights = gather(resp)
    msg, moved, n = per_coder(stats, _messages, weights, MESSAGES), 0.0, 1
    for n in range(2, max(1, rounds) + 1):
        stats, weights = gather(items_step(msg, weights))
        nxt = per_coder(stats, _messages, weights, MESSAGES)
        moved, msg = change(msg, nxt), nxt
        if moved < tolerance:
            break
    resp = items_step(msg, weights)

    names = F.create_map(*[x for v, cs in classes.items() for x in (F.lit(v), F.array(*[F.lit(c) for c in cs]))])
    items = (
        resp.groupBy("variable", "item")
        .agg(F.first("q").alias("q"), F.count_distinct("coder").alias("n_coders"), F.sum("n").cast("bigint").alias("n_labels"))
        .withColumn("confidence", F.array_max("q"))
        .select("variable", "item", F.element_at(names[F.col("variable")], F.array_position("q", F.col("confidence")).cast("int")).alias("label"), "confidence", "n_coders", "n_labels")
    )
    items = cut_lineage(items)
    t.unpersist()
    quality = per_coder(stats, _quality, weights, QUALITY)
    return Consensus(items, spark.createDataFrame(quality, QUALITY) if small else quality, n, moved)


def krippendorff(labels: DataFrame) -> DataFrame:
    """``(variable, n_items, n_labels, alpha)``: nominal agreement over all labels of items with at least two.

    Every label is one rating, repeats included. Without any pair, or with one category only, ``alpha`` is null.
    """
    t = tally(labels).groupBy("variable", "item", "label").agg(F.sum("n").cast("double").alias("n"))
    item = t.groupBy("variable", "item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("same")).where("m > 1")
    # disagreement seen: ordered pairs of different labels within an item, each item weighing its number of labels
    seen = item.groupBy("variable").agg(F.count("*").alias("n_items"), F.sum("m").alias("n"), F.sum((F.col("m") * F.col("m") - F.col("same")) / (F.col("m") - 1)).alias("d"))
    totals = t.join(item.select("variable", "item"), ["variable", "item"], "left_semi").groupBy("variable", "label").agg(F.sum("n").alias("c"))
    chance = totals.groupBy("variable").agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
    expected = (F.col("n") * F.col("n") - F.col("cc")) / (F.col("n") - 1)
    return seen.join(chance, "variable").select("variable", "n_items", F.col("n").cast("bigint").alias("n_labels"), (1 - F.try_divide(F.col("d"), expected)).alias("alpha"))


def collapse_ratings(df: DataFrame, item: str, row_key: str, labels: str, variables: list[str], distinct_rows: bool) -> DataFrame:
    """Long ``(variable, item, coder, value)`` from a map<string, struct<value, coder, date>> column.

    ``distinct_rows`` drops repeated rows (same item and same whole map). Null maps, absent keys and null values give no row.
    """
    base = df.select(F.col(item).alias("item"), F.col(row_key).alias("__row"), F.col(labels).alias("__m")).where(F.col("__m").isNotNull())
    if distinct_rows:
        entries = F.to_json(F.array_sort(F.map_entries("__m")))
        base = base.withColumn("__e", entries).groupBy("item", "__e").agg(F.first("__m").alias("__m"))
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.element_at("__m", F.lit(v)).alias("x")) for v in variables])
    long = base.select("item", F.explode(pairs).alias("p"))
    return long.select(F.col("p.variable").alias("variable"), "item", F.col("p.x.coder").alias("coder"), F.col("p.x.value").alias("value")).where("value IS NOT NULL")
