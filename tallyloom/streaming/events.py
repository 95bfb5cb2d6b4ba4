"""Streaming forms: replayed files with checkpoint, windows with watermark, latest state, rate limit per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def replay(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of parquet files as a stream, some files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, ts: str, keys: list[str], length: str, slide: str | None, late: str) -> DataFrame:
    """Counts per key and window; rows later than the watermark are dropped by it."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.withWatermark(ts, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def upsert_latest(events: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str, buckets: int = 16):
    """Keeps the latest row per key in a parquet table of ``buckets`` parts by a hash of the key.

    A batch rewrites only the buckets that its keys fall into, and pre-aggregates before it meets them; a bucket's versions
    are folders named by batch, so a batch that runs again after a failure writes the same result, and versions before the
    last two are removed. An empty stream writes nothing. Returns the started query.
    """
    from tallyloom.operators.windows import latest_state

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = latest_state(batch, keys, order).withColumn("__b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        hit = [r[0] for r in new.select("__b").distinct().collect()]  # at most ``buckets``
        held = {b: v for b, v in _versions(spark, path, n).items() if b in hit}
        rows = new.drop("__b")
        if held:
            rows = rows.unionByName(spark.read.parquet(*[f"{path}/bucket={b}/version={max(v)}" for b, v in sorted(held.items())]))
        out = latest_state(rows, keys, order).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).withColumn("version", F.lit(n))
        # only the folders of this batch are written over
        out.repartition(min(buckets, max(len(hit), 1)), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(path)
        new.unpersist()
        _drop_old(spark, path, {b: sorted(v)[:-1] for b, v in held.items()})

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, list[int]]:
    """The versions of every bucket, those of batch ``before`` and later left out."""
    fs, p = _fs(spark, path)
    out: dict[int, list[int]] = {}
    for s in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "bucket=*/version=*")) or [] if fs.exists(p) else []:
        b, v = (int(x.split("=")[1]) for x in s.getPath().toString().rstrip("/").split("/")[-2:])
        if before is None or v < before:
            out.setdefault(b, []).append(v)
    return out


def _drop_old(spark: SparkSession, path: str, old: dict[int, list[int]]) -> None:
    fs, _ = _fs(spark, path)
    for b, versions in old.items():
        for v in versions:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}/version={v}"), True)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`upsert_latest` keeps: the last version of every bucket."""
    return spark.read.parquet(*[f"{path}/bucket={b}/version={max(v)}" for b, v in sorted(_versions(spark, path).items())])


def rate_limited(events: DataFrame, key: str, ts: str, per_minute: int, per_hour: int) -> DataFrame:
    """``(key, ts, allowed)``: requests that stay within both sliding windows of their key, by custom state.

    Only allowed requests count. Rows of a batch are taken in time order. The state of a key goes when the watermark is an
    hour past its last request.
    """
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        past = list(state.get[0]) if state.exists else []
        out = []
        for t in sorted(x for b in batches for x in b["us"].tolist()):
            past = [p for p in past if p >= t - 3_600_000_000]
            ok = len(past) < per_hour and sum(p >= t - 60_000_000 for p in past) < per_minute
            if ok:
                past.append(t)
            out.append((k[0], t, ok))
        state.update((past,))
        state.setTimeoutTimestamp(max(out[-1][1] // 1000, state.getCurrentWatermarkMs()) + 3_600_000)
        yield pd.DataFrame(out, columns=["k", "us", "allowed"])

    timed = events.select(F.col(key).alias("k"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", "1 hour")
    slim = timed.withColumn("us", F.unix_micros("ts"))
    limited = slim.groupBy("k").applyInPandasWithState(step, f"k {kind}, us bigint, allowed boolean", "past array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return limited.select(F.col("k").alias(key), F.timestamp_micros("us").alias(ts), "allowed")
