"""Filling fixed-capacity containers with whole items, planned over the histogram of lengths.

The plan is made for counts of lengths, of which there are at most ``capacity``, not for documents: lengths are taken in
falling order, and each item goes into the open container with the least room that still holds it (best fit decreasing).
Containers with the same contents are one group with a count, so all items of a length are placed at once. Documents then
take the planned slots by their rank within their length. Ranks are counted in hashed chunks of a length and shifted by
the sizes of the chunks before, so that a length that a third of all documents share is still ranked by many tasks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.encode import token_counts
from tallyloom.runtime import cut_lineage

#: Items of one length and chunk that one task ranks, on average.
CHUNK_ITEMS = 200_000


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, dict[int, int]]], int]:
    """Patterns ``(times, {length: items per container})`` that place all items, and the number of containers.

    The same containers as best fit decreasing item by item would open, as equal items and equal containers are taken
    together.
    """
    left = {s: c for s, c in histogram.items() if 0 < s <= capacity and c > 0}
    done: list[tuple[int, dict[int, int]]] = []
    rooms: list[tuple[int, int]] = []  # (room, group), in order
    groups: list[tuple[int, dict[int, int]]] = []

    def put(times: int, use: dict[int, int], room: int, least: int) -> None:
        if room < least:
            done.append((times, use))
        else:
            groups.append((times, use))
            insort(rooms, (room, len(groups) - 1))

    least = min(left, default=0)
    for s in sorted(left, reverse=True):
        c = left[s]
        # the tightest containers first; each takes what it can before the next, as its room is the tightest from then on
        while c and (at := bisect_left(rooms, (s, -1))) < len(rooms):
            room, g = rooms.pop(at)
            times, use = groups[g]
            k = room // s
            full, rest = min(times, c // k), 0
            if full:
                put(full, {**use, s: k}, room - k * s, least)
            if full < times and (rest := min(c - full * k, k)):
                put(1, {**use, s: rest}, room - rest * s, least)
            if times > full + bool(rest):
                put(times - full - bool(rest), use, room, least)
            c -= full * k + rest
        k = capacity // s
        if c >= k:
            put(c // k, {s: k}, capacity - k * s, least)
        if c % k:
            put(1, {s: c % k}, capacity - c % k * s, least)
    patterns = done + [groups[g] for _, g in rooms]
    return patterns, sum(times for times, _ in patterns)


def _slots(patterns: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """For every length and pattern: first rank, first container and items per container, in order of (length, rank)."""
    used: dict[int, int] = {}
    rows, container = [], 0
    for times, use in patterns:
        for s, k in use.items():
            rows.append((s, used.get(s, 0), container, k))
            used[s] = used.get(s, 0) + times * k
        container += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def pack_items(sizes: DataFrame, key: str, size: str, capacity: int = 2048) -> DataFrame:
    """``(key, part_no, n_parts, first_token, n_tokens, container_no)``: every item in a container, none split unless larger than one.

    An item above ``capacity`` becomes full containers and one remainder, which is packed like an item. An item without
    tokens (null or empty text; a null size counts as 0) takes no space and joins a container chosen by hash. Items of
    one length are interchangeable, so ties need no rule; rows that repeat a key are separate items; a null key is kept.
    An empty table gives an empty result. ``container_no`` counts from 1.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = sizes.schema[key].dataType.simpleString()
    base = sizes.select(F.col(key).alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n"))
    base = base.withColumn("n_full", F.floor(F.col("n") / capacity)).withColumn("rest", F.col("n") % capacity)
    base = cut_lineage(base)
    # at most capacity + 1 rows, whatever the size of the corpus
    hist = base.groupBy("rest").agg(F.count("*").alias("c"), F.sum("n_full").alias("f")).collect()
    counts = {int(r["rest"]): int(r["c"]) for r in hist if r["rest"] > 0}
    n_full = sum(int(r["f"]) for r in hist)
    n_items = sum(int(r["c"]) for r in hist)
    patterns, n_planned = plan(counts, capacity)
    slots = _slots(patterns)
    n_containers = max(1, n_planned + n_full)

    # full parts of large items: containers after the planned ones, numbered by rank over hashed chunks
    chunks = max(8, -(-n_items // CHUNK_ITEMS))
    ranked = _rank(base.where("rest > 0").withColumn("__of", F.col("rest")), chunks)
    spec = sizes.sparkSession.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, first, container, per = spec.value
        order = s * (1 << 44) + first
        for b in batches:
            rest, rank = b.column("rest").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(order, rest * (1 << 44) + rank, side="right") - 1
            number = container[at] + (rank - first[at]) // per[at] + 1
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("n"), b.column("rest"), pa.array(number, pa.int64())], names=["k", "n", "rest", "container_no"])

    n_parts = F.ceil(F.greatest(F.col("n"), F.lit(1)) / capacity)
    placed = ranked.select("k", "n", "rest", "rank").mapInArrow(place, f"k {kind}, n bigint, rest bigint, container_no bigint")
    out = placed.select("k", n_parts.alias("part_no"), n_parts.alias("n_parts"), (F.col("n") - F.col("rest")).alias("first_token"), F.col("rest").alias("n_tokens"), "container_no")
    free = base.where("n = 0").select("k", F.lit(1).cast("bigint").alias("part_no"), F.lit(1).cast("bigint").alias("n_parts"), F.lit(0).cast("bigint").alias("first_token"), F.lit(0).cast("bigint").alias("n_tokens"), (F.pmod(F.xxhash64("k"), F.lit(n_containers)) + 1).alias("container_no"))
    large = base.where("n_full > 0").withColumn("part", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_full")))).withColumn("__of", F.lit(0).cast("bigint"))
    large = _rank(large, chunks).select("k", F.col("part").alias("part_no"), n_parts.alias("n_parts"), ((F.col("part") - 1) * capacity).alias("first_token"), F.lit(capacity).cast("bigint").alias("n_tokens"), (F.col("rank") + n_planned + 1).alias("container_no"))
    out = out.unionByName(free).unionByName(large)
    return out.select(F.col("k").alias(key), *[F.col(c).cast("bigint").alias(c) for c in ("part_no", "n_parts", "first_token", "n_tokens", "container_no")])


def _rank(df: DataFrame, chunks: int) -> DataFrame:
    """``rank`` from 0 within ``__of``: row numbers within hashed chunks, shifted by the chunks before."""
    parts = [c for c in ("k", "part") if c in df.columns]
    chunked = df.withColumn("__chunk", F.pmod(F.xxhash64(*parts, F.lit(17)), F.lit(chunks)))
    numbered = chunked.withColumn("__rn", F.row_number().over(W.partitionBy("__of", "__chunk").orderBy(*parts)))
    sizes = chunked.groupBy("__of", "__chunk").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy("__of").orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    return numbered.join(offsets, ["__of", "__chunk"]).withColumn("rank", (F.col("__before") + F.col("__rn") - 1).cast("bigint"))


def pack_corpus(df: DataFrame, key: str, text: str, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """:func:`pack_items` over the token counts of ``text``."""
    return pack_items(token_counts(df, key, text, path), key, "n_tokens", capacity)


def container_fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row ``(n_containers, n_tokens, least_possible, fill)`` about a packing."""
    per = packed.groupBy("container_no").agg(F.sum("n_tokens").alias("t"))
    tot = per.agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_tokens"), F.coalesce(F.max("t"), F.lit(0)).alias("fullest"))
    return tot.withColumn("least_possible", F.ceil(F.col("n_tokens") / capacity)).withColumn("fill", F.try_divide(F.col("n_tokens"), F.col("n_containers") * capacity))
