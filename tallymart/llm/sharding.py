"""Shards of equal bytes by histogram sort.

The rows' order is that of (hash of the text, doc_id), so equal texts lie together. Splitters for the shards, and for
the ranges that each shard is numbered in, are found without sorting: every round counts the exact bytes below a set
of probe keys over all partitions, keeps for each splitter the narrowest interval of probes around its target, and
probes inside it, until the bytes below a splitter are within ``TOLERANCE`` of a shard of the target or the interval
holds no further key. Then each row is sent to its range once.

A row's size is the UTF-8 bytes of its text (none for null) plus ``OVERHEAD``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymart.llm import common

OVERHEAD = 16
TOLERANCE = 0.001
PROBES, MOST_PROBES = 64, 1 << 17
RANGE_BYTES = 1 << 30
_LAST = (1 << 128) - 1


def _halves(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([k >> 64 for k in keys], np.uint64), np.array([k & (2**64 - 1) for k in keys], np.uint64)


def _unsigned(column: pa.Array) -> np.ndarray:
    """Signed 64-bit values in their order as unsigned ones; null is the least."""
    shifted = column.fill_null(-(2**63)).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
    return shifted


def places(high: np.ndarray, low: np.ndarray, keys: list[int]) -> np.ndarray:
    """For rows with keys (high, low): how many of the sorted ``keys`` are at or below each row's key."""
    top, bottom = _halves(keys)
    out = np.searchsorted(top, high, "left")
    end = np.searchsorted(top, high, "right")
    tied = np.flatnonzero(out < end)
    for first in np.unique(out[tied]).tolist():
        rows = tied[out[tied] == first]
        last = end[rows[0]]
        out[rows] = first + np.searchsorted(bottom[first:last], low[rows], "right")
    return out


def _histogram(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        held, many = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1, np.int64)
        for batch in batches:
            at = places(_unsigned(batch.column(0)), _unsigned(batch.column(1)), keys)
            held += np.bincount(at, batch.column(2).to_numpy(), len(held))
            many += np.bincount(at, minlength=len(many))
        some = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(held[some].astype(np.int64)), pa.array(many[some])], names=["place", "bytes", "n"]
        )

    return rows


def splitters(keyed: DataFrame, targets: list[tuple[float, float]]) -> list[int]:
    """One key for each (bytes, tolerance), such that the rows below it hold about so many bytes.

    ``keyed`` has (hash, doc_id, size). Only the histograms, one count for each probe, reach the driver. An interval
    that holds a single row, or a single key, can't come nearer and is settled by its nearer end.
    """
    context = keyed.sparkSession.sparkContext
    # Per target the ends of its interval: key, bytes and rows below the key.
    ends = [[(0, 0.0, 0.0), (_LAST, float("inf"), float("inf"))] for _ in targets]
    chosen: list[int | None] = [None] * len(targets)
    while any(c is None for c in chosen):
        waiting = [i for i, c in enumerate(chosen) if c is None]
        each = max(2, min(PROBES, MOST_PROBES // len(waiting)))
        probes = {lo[0] + (up[0] - lo[0]) * j // each for lo, up in (ends[i] for i in waiting) for j in range(1, each + 1)}
        keys = sorted(probes - {0})
        counted = keyed.mapInArrow(_histogram(context.broadcast(keys)), "place long, bytes long, n long")
        held = {r[0]: r[1:] for r in counted.groupBy("place").agg(F.sum("bytes"), F.sum("n")).collect()}
        # A row at place j is at or above j keys, so the rows below key j are those at places 0 to j.
        below = np.cumsum([held.get(j, (0, 0)) for j in range(len(keys) + 1)], axis=0)[:-1]
        for i in waiting:
            target, tolerance = targets[i]
            j = int(np.searchsorted(below[:, 0], target, "right"))
            if j and keys[j - 1] > ends[i][0][0]:
                ends[i][0] = (keys[j - 1], *map(float, below[j - 1]))
            if j < len(keys) and keys[j] <= ends[i][1][0]:
                ends[i][1] = (keys[j], *map(float, below[j]))
            low, up = ends[i]
            near = min((low, up), key=lambda e: abs(e[1] - target))
            if abs(near[1] - target) <= tolerance or up[0] - low[0] <= 1 or up[2] - low[2] <= 1:
                chosen[i] = near[0]
    return sorted(chosen)


def _placed(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        for batch in batches:
            at = places(_unsigned(batch.column(0)), _unsigned(batch.column(1)), keys)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(at, pa.int32())], schema=batch.schema)

    return rows


@common.on_executors
def sharded(docs: DataFrame, shards: int = 40, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``), size, shard and slot, the row's place in its shard from 0.

    Repeated rows have one key and lie in one shard. An empty table gives no rows.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    key = [F.xxhash64("text").alias("hash"), F.col("doc_id").cast("long").alias("doc_id"), size.alias("size")]
    keyed = common.written(docs.select(*key), "keys")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    ranges = max(1, -(-total // (shards * range_bytes)))
    part = total / (shards * ranges)
    targets = [(part * i, TOLERANCE * total / shards if i % ranges == 0 else part / 10) for i in range(1, shards * ranges)]
    keys = splitters(keyed, targets) if total else []
    shared = spark.sparkContext.broadcast(keys)
    counts = (
        keyed.select("hash", "doc_id", F.lit(0).alias("range"))
        .mapInArrow(_placed(shared), "hash long, doc_id long, range int")
        .groupBy("range")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # One row for each range of about range_bytes.
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("shard", (F.col("range") / ranges).cast("int")).select(
        "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    rows = docs.select(*key[:2], key[2], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.lit(0).alias("range"))
    placed = rows.mapInArrow(_placed(shared), rows.schema).join(offsets, "range")
    inside = F.row_number().over(Window.partitionBy("range").orderBy("hash", "doc_id"))
    return placed.select(
        "row", "size", (F.col("range") / ranges).cast("int").alias("shard"), (F.col("before") + inside - 1).cast("long").alias("slot")
    )
