"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm.common import dropped, on_executors, written

#: Edge lists up to this length (16 MB) go to one task; longer ones take rounds of joins.
EDGES_AT_ONCE = 1 << 20


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of a bounded edge list: every node takes the least label around it, and labels are followed, until none changes."""
    held = pa.Table.from_batches(batches, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    nodes, ends = np.unique(np.concatenate((held.column("u").to_numpy(), held.column("v").to_numpy())), return_inverse=True)
    u, v = ends[: held.num_rows], ends[held.num_rows :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def _by_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Points each neighbour of a node at the least id among the node and its neighbours.

    With ``larger_only`` a node passes on its larger neighbours, otherwise itself and its smaller ones.
    """
    if larger_only:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
        moved = both.where("v > u")
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("least"))
        moved = both.union(both.select("u", F.col("u").alias("v")).distinct())
    hops = moved.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return hops.where("u <> v").distinct()


@on_executors
def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); a component is named by its least node.

    A list of up to ``EDGES_AT_ONCE`` edges is settled in one task. A longer one takes large-star and small-star
    rounds until the edges stay as they are; each round is written to the shared folder. A node with very many neighbours is summed up on the map side and its join is split by AQE.
    """
    now = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    if now.count() <= EDGES_AT_ONCE:
        found = written(now.repartition(1).mapInArrow(_joined, "node long, component long"), "components")
        dropped(now)
        return found
    mark = None
    while True:
        before, now = now, written(_by_least(_by_least(now, True), False), "edges")
        dropped(before)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            least = now.select("v", F.col("v").alias("component")).distinct()
            return now.union(least).toDF("node", "component")
        mark = seen
