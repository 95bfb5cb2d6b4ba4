"""Topics over vectors and words: similarity filter, centroids, density clustering, class TF-IDF, diverse re-ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.runtime import cut_lineage

#: Bytes up to which a matrix of reference vectors is broadcast.
MAX_MATRIX = 256 << 20
#: Vectors in one block where all are compared with all.
BLOCK_ROWS = 2000


def _blocks(refs: DataFrame, vec: str, most: int) -> list[DataFrame]:
    """The references in parts whose matrices hold about ``most`` bytes at the most."""
    n = refs.count()
    size = refs.select(F.max(F.size(vec))).collect()[0][0] or 0
    # half of the bound, as hashing does not fill the blocks evenly
    nb = 1 if n * size * 8 <= most else -(-n * size * 16 // most)
    return [refs] if nb == 1 else [refs.where(F.pmod(F.xxhash64(vec), F.lit(nb)) == i) for i in range(nb)]


def _matrix(refs: DataFrame, key: str, vec: str) -> tuple[list, np.ndarray]:
    rows = refs.select(key, vec).orderBy(key).collect()
    m = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)
    return [r[0] for r in rows], m


def max_similarity(docs: DataFrame, key: str, vec: str, refs: DataFrame, ref_key: str, ref_vec: str, most: int = MAX_MATRIX) -> DataFrame:
    """``(key, similarity, nearest)``: greatest cosine of every document to the reference vectors.

    The references are one broadcast matrix, or one after another where they exceed ``most`` bytes; a block of documents is multiplied with it at a time, so no
    pairs of rows are made. Zero vectors have similarity 0; of equals the smallest reference key wins. Null vectors and empty
    references give null.
    """
    blocks = _blocks(refs, ref_vec, most)
    if len(blocks) > 1:
        # each part writes its best to the checkpoint, so that one matrix is held at a time; rows are known by a number, as keys may repeat
        num = cut_lineage(docs.select(F.monotonically_increasing_id().alias("__n"), F.col(key).alias("__k"), F.col(vec).alias("__v")))
        best = None
        for part in blocks:
            got = max_similarity(num, "__n", "__v", part, ref_key, ref_vec, 1 << 62)
            best = cut_lineage(got if best is None else best.unionByName(got))
        w = W.partitionBy("__n").orderBy(F.desc_nulls_last(F.round("similarity", 12)), F.asc_nulls_last("nearest"))
        top = best.withColumn("__r", F.row_number().over(w)).where("__r = 1")
        return num.select("__n", "__k").join(top, "__n").select(F.col("__k").alias(key), "similarity", "nearest")
    names, m = _matrix(refs, ref_key, ref_vec)
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    shared = docs.sparkSession.sparkContext.broadcast((names, unit))
    kt, rt = docs.schema[key].dataType.simpleString(), refs.schema[ref_key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, unit = shared.value
        for b in batches:
            sim, near = np.full(len(b), np.nan), [None] * len(b)
            ok = b["v"].notna().to_numpy()
            if ok.any() and len(names):
                x = np.stack(b["v"][ok].to_numpy()).astype(np.float64)
                s = (x @ unit.T) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                at = np.round(s, 12).argmax(axis=1)
                sim[ok] = s[np.arange(len(x)), at]
                for i, j in zip(np.flatnonzero(ok), at):
                    near[i] = names[j]
            yield pd.DataFrame({"k": b["k"], "similarity": pd.Series(sim).astype(object).where(~np.isnan(sim), None), "nearest": near})

    out = docs.select(F.col(key).alias("k"), F.col(vec).alias("v")).mapInPandas(run, f"k {kt}, similarity double, nearest {rt}")
    return out.withColumnRenamed("k", key)


def bucket(score: Column, auto: float, low: float) -> Column:
    """``auto`` from ``auto`` on, ``borderline`` from ``low`` on, else ``below``."""
    return F.when(score >= auto, "auto").when(score >= low, "borderline").otherwise("below")


def centroids(df: DataFrame, topic: str, vec: str) -> DataFrame:
    """``(topic, n, centroid)``: mean of the unit vectors of a topic, brought to length 1."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    parts = df.where(F.col(topic).isNotNull()).select(topic, norm.alias("__n"), F.posexplode(vec).alias("i", "x"))
    mean = parts.groupBy(topic, "i").agg(F.avg(F.coalesce(F.try_divide(F.col("x").cast("double"), F.col("__n")), F.lit(0.0))).alias("m"), F.count("*").alias("n"))
    arr = mean.groupBy(topic).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    length = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))
    return arr.withColumn("__l", length).select(topic, "n", F.transform("c", lambda x: F.coalesce(F.try_divide(x, F.col("__l")), F.lit(0.0))).alias("centroid"))


def nearest_centroid(docs: DataFrame, key: str, vec: str, cents: DataFrame, topic: str, least: float) -> DataFrame:
    """``(key, topic, similarity)``: the nearest topic under cosine, -1 below ``least``."""
    near = max_similarity(docs, key, vec, cents, topic, "centroid")
    return near.select(key, F.when(F.col("similarity") >= least, F.col("nearest")).otherwise(F.lit(-1)).alias(topic), "similarity")


def class_tfidf(tokens: DataFrame, topic: str, token: str, damp: bool = True, max_share: float = 1.0, min_topics: int = 1) -> DataFrame:
    """``(topic, token, n, weight)`` from one row per token occurrence.

    Weight = (share of the topic's words, square-rooted if ``damp``) * ln(1 + A / f), A the mean words per topic (whole),
    f the token's count. Tokens in more than ``max_share`` of the topics or fewer than ``min_topics`` are left out.
    """
    tf = tokens.groupBy(topic, token).agg(F.count("*").alias("n"))
    spread = tf.groupBy(token).agg(F.sum("n").alias("f"), F.count("*").alias("nt"))
    topics = tf.select(topic).distinct().agg(F.count("*").alias("t"))
    kept = tf.join(spread, token).join(F.broadcast(topics)).where((F.col("nt") <= F.greatest(F.lit(max_share) * F.col("t"), F.lit(1.0))) & (F.col("nt") >= min_topics))
    size = kept.groupBy(topic).agg(F.sum("n").alias("w"))
    mean = size.agg(F.floor(F.avg("w")).alias("a"))
    share = F.col("n") / F.col("w")
    weight = (F.sqrt(share) if damp else share) * F.ln(1 + F.col("a") / F.col("f"))
    return kept.join(size, topic).join(F.broadcast(mean)).select(topic, token, "n", weight.alias("weight"))


def diverse_top(cands: DataFrame, topic: str, word: str, score: str, vec: str, k: int, diversity: float = 0.3) -> DataFrame:
    """``(topic, place, word)``: maximal marginal relevance over the at most 30 best candidates of a topic.

    The candidates are cut to 30 per topic before the group is handed to a task, so no group is unbounded.
    """
    w = W.partitionBy(topic).orderBy(F.desc(score), word)
    best = cands.withColumn("__r", F.row_number().over(w)).where("__r <= 30").select(topic, word, score, vec)
    tt = cands.schema[topic].dataType.simpleString()

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, word], ascending=[False, True]).reset_index(drop=True)
        v = np.stack(pdf[vec].to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        sim, rel = v @ v.T, pdf[score].to_numpy(float)
        chosen = [0]
        while len(chosen) < min(k, len(pdf)):
            gain = (1 - diversity) * rel - diversity * sim[:, chosen].max(axis=1)
            gain[chosen] = -np.inf
            chosen.append(int(gain.argmax()))
        return pd.DataFrame({topic: pdf[topic].iloc[0], "place": range(1, len(chosen) + 1), word: pdf[word].iloc[chosen].to_numpy()})

    return best.groupBy(topic).applyInPandas(pick, f"{topic} {tt}, place int, {word} string")


def near_pairs(base: DataFrame, least: float, block: int = BLOCK_ROWS) -> DataFrame:
    """``(x, y, s)``: every pair of different keys of ``base`` (k, v) with a cosine ``s`` of at least ``least``, in both directions.

    Exact: each block of about ``block`` vectors is multiplied with itself and every later block. Zero vectors have cosine 0;
    of a repeated key the nearest vector counts.
    """
    kt = base.schema["k"].dataType.simpleString()
    nb = max(1, -(-base.count() // block))
    part = base.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(nb)).cast("int"))
    left = part.withColumn("i", F.col("b")).withColumn("j", F.explode(F.sequence(F.col("b"), F.lit(nb - 1))))
    right = part.withColumn("j", F.col("b")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("b"))))

    def unit(v: pd.Series) -> np.ndarray:
        m = np.stack(v.to_numpy()).astype(np.float64)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            ka, kb, ub = a["k"].to_numpy(), b["k"].to_numpy(), unit(b["v"])
            ua, own = unit(a["v"]), a["i"].iloc[0] == a["j"].iloc[0]
            for lo in range(0, len(ka), 500):
                s = np.round(ua[lo : lo + 500] @ ub.T, 12)
                r, c = np.nonzero(s >= least)
                x, y, v = ka[lo + r], kb[c], s[r, c]
                # a block meets itself once and gives both directions, two blocks meet in one of them
                ok = x < y if own else np.full(len(x), True)
                out.append(pd.DataFrame({"x": x[ok], "y": y[ok], "s": v[ok]}))
        return pd.concat(out) if out else pd.DataFrame({"x": [], "y": [], "s": []})

    # one partition for each pair of blocks at most, as adaptive execution would put them together by their few bytes
    parts = min(2000, nb * (nb + 1) // 2)
    left, right = left.select("i", "j", "k", "v").repartition(parts, "i", "j"), right.select("i", "j", "k", "v").repartition(parts, "i", "j")
    half = cut_lineage(left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(compare, f"x {kt}, y {kt}, s double"))
    both = half.unionByName(half.select(F.col("y").alias("x"), F.col("x").alias("y"), "s"))
    return both.groupBy("x", "y").agg(F.max("s").alias("s"))


def density_clusters(docs: DataFrame, key: str, vec: str, least: float = 0.8, core: int = 5, smallest: int = 10, planes: int = 6, tables: int = 8, seed: int = 42, block: int = BLOCK_ROWS) -> DataFrame:
    """``(key, cluster)``: connected dense regions under cosine, -1 for noise.

    All vectors are compared in blocks, so no neighbour is missed (``planes``, ``tables`` and ``seed`` of the former search
    in cells are accepted and not read); a document with ``core`` neighbours of at least ``least`` is a core; cores that are
    neighbours are one cluster, found by propagating the smallest key until nothing moves; other documents join the nearest
    core's cluster; clusters under ``smallest`` are noise.
    """
    base = docs.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.col(key).alias("k"), F.col(vec).alias("v"))
    near = cut_lineage(near_pairs(base, least, block))
    cores = cut_lineage(near.groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") >= core).select(F.col("x").alias("k")))
    edges = cut_lineage(near.join(cores.select(F.col("k").alias("x")), "x").join(cores.select(F.col("k").alias("y")), "y").select("x", "y"))
    label = cores.select("k", F.col("k").alias("c"))
    # a label only ever falls to a smaller key, so this ends
    while True:
        best = edges.join(label.select(F.col("k").alias("y"), F.col("c").alias("cy")), "y").groupBy("x").agg(F.min("cy").alias("m"))
        step = label.join(best, label["k"] == best["x"], "left").select("k", F.least("c", F.coalesce("m", "c")).alias("c2"), "c")
        # follow the label of the label, which halves long chains
        jump = step.select(F.col("k").alias("r"), F.col("c2").alias("rc"))
        nxt = cut_lineage(step.join(jump, step["c2"] == jump["r"], "left").select("k", F.least("c2", F.coalesce("rc", "c2")).alias("c"), (F.col("c") != F.least("c2", F.coalesce("rc", "c2"))).alias("moved")))
        label = nxt.select("k", "c")
        if nxt.where("moved").limit(1).count() == 0:
            break
    rim = near.join(cores.select(F.col("k").alias("y")), "y").join(label.select(F.col("k").alias("y"), "c"), "y").groupBy("x").agg(F.max_by("c", F.struct("s", "y")).alias("c"))
    member = label.unionByName(rim.select(F.col("x").alias("k"), "c").join(cores, "k", "left_anti"))
    sizes = member.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") >= smallest)
    kept = member.join(sizes, "c").select("k", "c")
    return base.select("k").join(kept, "k", "left").select(F.col("k").alias(key), F.coalesce("c", F.lit(-1)).alias("cluster"))


def reduced(df: DataFrame, key: str, vec: str, k: int = 5) -> DataFrame:
    """``(key, reduced)``: the first ``k`` principal components of the vectors (fewer if they have fewer dimensions)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    base = df.where(F.col(vec).isNotNull()).select(key, array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("__v"))
    first = base.select(F.size(vector_to_array("__v"))).limit(1).collect()
    if not first:
        return df.limit(0).select(key, F.lit(None).cast("array<double>").alias("reduced"))
    return PCA(k=min(k, first[0][0]), inputCol="__v", outputCol="__r").fit(base).transform(base).select(key, vector_to_array("__r").alias("reduced"))
