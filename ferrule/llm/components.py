"""Connected components of an edge table, by alternating stars.

Every round ends in a checkpoint, so lineage stays short and a lost executor costs no
more than a round. Edges that fit a task (EDGES) are joined in one, without rounds, whose
many small jobs the driver would keep a record of each. A node with very many neighbours is a hot key:
its least neighbour is found by a partial aggregate, and the join that hands it back
has plain exchanges on both sides, which adaptive execution splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import cut

#: Edges a partition of the checkpoints between rounds, and up to which no rounds are made; up to FEW, a node's least neighbour is found again instead of checkpointed.
EDGES, FEW = 250_000, 1_000_000


class Forest:
    """Union-find over positions; keeps the edges that joined something."""

    def __init__(self, n: int):
        self.up, self.edges = list(range(n)), []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((x, y))


def _joined(batches):
    """(node, root) of all nodes of a task's edges."""
    parts = [np.stack([batch.column(k).to_numpy() for k in (0, 1)], axis=1) for batch in batches]
    # places follow the order of the nodes, so the least place is the least node
    nodes, ends = np.unique(np.concatenate([np.zeros((0, 2), dtype=np.int64), *parts]), return_inverse=True)
    forest = Forest(len(nodes))
    for x, y in ends.reshape(-1, 2).tolist():
        forest.join(x, y)
    roots = np.fromiter(map(forest.root, range(len(nodes))), dtype=np.int64, count=len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[roots])], names=["node", "root"])


def _cut(edges: DataFrame, n: int) -> DataFrame:
    """The rows checkpointed in as many files as about n edges are worth."""
    return cut(edges.coalesce(n // EDGES + 1))


def _split(least: DataFrame, n: int) -> DataFrame:
    """One side of a join on a node, which has plain exchanges on both sides where there are many edges."""
    return _cut(least, n) if n > FEW else least


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the least node reachable.

    Loops and repeated edges change nothing; no edges give no rows.
    """
    # every edge points from the larger to the smaller end
    stars = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    n = stars.count()
    stars = stars.coalesce(n // EDGES + 1)
    before = None
    while n > EDGES:
        # large star: larger neighbours of a node move to the least of all its neighbours
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _split(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), n)
        large = _cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), n)
        # small star: smaller neighbours of a node, and the node, move to the least of them
        least = _split(large.groupBy("u").agg(F.min("v").alias("m")), n)
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        stars = _cut(small, n)
        now = tuple(stars.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if now == before:
            break
        before, n = now, now[0]
    else:
        return cut(stars.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_joined, "node long, root long"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
