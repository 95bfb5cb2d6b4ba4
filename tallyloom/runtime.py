"""Session-level helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the broadcast side of :func:`salted_join`: a group with at least total / HOT_SHARE rows is hot,
#: so there are never more than HOT_SHARE hot groups, whatever the size of the data.
HOT_SHARE = 1000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for ``checkpoint()``. The session's ``spark.checkpoint.dir`` is used where it is set;
    only a local session without it gets a temporary folder."""
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = os.path.join(tempfile.gettempdir(), "tallyloom-checkpoints")
    sc.setCheckpointDir(conf)
    return conf


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget how it was made."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Repartition a small but compute-heavy input so that all cores take part.

    The number of partitions never falls below what the scan already has, so a large table is not squeezed.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    have = df.rdd.getNumPartitions()
    return df if have >= want else df.repartition(want)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], count_col: str, row_key: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right`` (one row per key, ``count_col`` = rows of ``left`` with that key) without a hot task.

    Keys with at least ``total / HOT_SHARE`` rows are hot; there are at most HOT_SHARE of them, which bounds the
    broadcast. Hot keys are spread over as many salts as they have cold-group equivalents; all rows still take part in
    one shuffle join. Null keys never match. ``how`` is ``inner`` or ``left``.
    """
    floor = max(1, total // HOT_SHARE)
    hot = right.where(F.col(count_col) >= floor).select(
        *[F.col(c).alias(f"__h_{c}") for c in on],
        F.least(F.lit(256), F.ceil(F.col(count_col) / F.lit(floor * 4)) + 1).cast("int").alias("__salts"),
    )
    cond = None
    for c in on:
        e = F.col(c) == F.col(f"__h_{c}")
        cond = e if cond is None else cond & e
    salt = F.when(F.col("__salts").isNotNull(), F.pmod(F.xxhash64(row_key), F.col("__salts").cast("long"))).otherwise(F.lit(0)).cast("int")
    salted = left.join(F.broadcast(hot), cond, "left").withColumn("__salt", salt).drop("__salts", *[f"__h_{c}" for c in on])
    salts = F.when(F.col(count_col) >= floor, F.least(F.lit(256), F.ceil(F.col(count_col) / F.lit(floor * 4)) + 1).cast("int")).otherwise(F.lit(1))
    spread_right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted.join(spread_right, [*on, "__salt"], how).drop("__salt")


def not_blank(c: Column) -> Column:
    """True for strings with at least one visible character (null gives false)."""
    return F.coalesce(c.rlike(r"[^\s\p{Z}\p{C}]"), F.lit(False))
