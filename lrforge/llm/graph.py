"""Connected components as DataFrame joins, and with edges contracted within tasks first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lrforge.llm.common import as_table, cut_lineage

EDGES_PER_TASK = 500_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """Returns (node, component) for every node of an undirected edge table.

    component is the smallest node that can be reached. Each round points every
    node at its smallest neighbour, follows the pointers to their roots by
    doubling, and contracts the edges to roots, so the edge table shrinks by at
    least half the nodes a round. Minima are combined before the shuffle; the
    joins have one row a key on one side, so that adaptive execution can split a
    hot key on the other. Every round ends in a reliable checkpoint.

    Edges with a null end are ignored, self-loops give a node of its own,
    repeated edges count once. An empty edge table gives an empty result.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    live = cut_lineage(edges.distinct())
    labels = live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("component", F.col("node"))
    live = live.where("a <> b")
    for _ in range(max_rounds):
        if live.isEmpty():
            return labels
        both = live.union(live.select("b", "a"))
        up = cut_lineage(both.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("to")).select("at", F.least("at", "to").alias("to")))
        while True:
            hop = up.select(F.col("at").alias("to"), F.col("to").alias("top"))
            further = cut_lineage(up.join(hop, "to").select("at", F.col("top").alias("to"), (F.col("top") != F.col("to")).alias("moved")))
            moved = not further.where("moved").isEmpty()
            up = further.select("at", "to")
            if not moved:
                break
        live = cut_lineage(
            live.join(up.select(F.col("at").alias("a"), F.col("to").alias("x")), "a")
            .join(up.select(F.col("at").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        labels = cut_lineage(
            labels.join(up.select(F.col("at").alias("component"), F.col("to").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        )
    raise RuntimeError(f"components are still open after {max_rounds} rounds")


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of a task's edges: the smallest node that these edges reach from it."""
    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, place = np.unique(np.concatenate([np.concatenate(p) for p in zip(*parts, strict=True)]), return_inverse=True)
    a, b = place[: len(place) // 2], place[len(place) // 2 :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def components_by_tasks(edges: DataFrame, a: str = "a", b: str = "b", per_task: int = EDGES_PER_TASK) -> DataFrame:
    """As connected_components, for nodes that are longs, with fewer rounds.

    Tasks of about per_task edges first find the components of their own edges, which
    leaves at most one edge a node and task; connected_components joins what several
    tasks have found. Up to per_task edges are one task and need no more.
    """
    held = as_table(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null"), "graph-edges")
    tasks = max(1, -(-held.count() // per_task))
    found = as_table(held.coalesce(tasks).mapInArrow(_roots, "node long, component long"), "graph-roots")
    return found if tasks == 1 else connected_components(found, "node", "component")
