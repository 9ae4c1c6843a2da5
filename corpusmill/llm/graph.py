"""Distributed union-find: local forests merged round by round, nothing gathered in one place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.runtime import cut
from corpusmill.functions.skew import HOT_ROWS, join_unique


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (u, v) and the smallest node of each one's component.

    Vectorised: every edge hooks the larger root under the smaller one, then paths are
    halved, until no edge joins two roots.
    """
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        ra, rb = parent[a], parent[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low < high
        if not open_.any():
            return nodes, nodes[parent]
        a, b = a[open_], b[open_]
        np.minimum.at(parent, high[open_], low[open_])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _forest(edges: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """The edges of each partition replaced by child-to-root edges of its forest.

    Works through blocks of ``limit`` edges, folding each block's forest into the next,
    so that a partition holds one entry a node and not one an edge.
    """

    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def fold():
            e = np.concatenate(held, axis=1)
            nodes, roots = local_roots(e[0], e[1])
            moved = nodes != roots
            return np.stack((nodes[moved], roots[moved]))

        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([np.asarray(c.to_numpy(zero_copy_only=False), np.int64) for c in batch.columns]))
                size += batch.num_rows
                if size > limit:
                    held = [fold()]
                    size = held[0].shape[1] // 2  # a forest alone must not fold again at once
        if held:
            e = fold()
            for k in range(0, e.shape[1], 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(e[0, k : k + (1 << 16)]), pa.array(e[1, k : k + (1 << 16)])], ["node", "root"])

    return edges.mapInArrow(run, "node bigint, root bigint")


def components(edges: DataFrame, max_rounds: int = 60, hot: int = HOT_ROWS) -> DataFrame:
    """(node, root): every node that has an edge to another, with the smallest node of its component.

    ``edges`` has two BIGINT columns; null ends, loops and repeated edges change nothing;
    without edges the result is empty.  A round compares the roots that a node got in
    different partitions (at most one a partition), builds the forest of what each
    partition then knows, and shortens the paths by one join; forests thereby merge
    hierarchically, in logarithmically many rounds.  Rows are spread by node, never by
    root: the star of a component that holds a third of all nodes lies in all partitions,
    each of which folds its part, and where its root is joined it is split as a hot key.
    """
    u, v = edges.columns
    clean = edges.select(F.col(u).cast("bigint").alias("u"), F.col(v).cast("bigint").alias("v")).filter("u <> v")
    forest = cut(_forest(clean))
    by_node = Window.partitionBy("node")
    for _ in range(max_rounds):
        least = forest.withColumn("least", F.min("root").over(by_node))
        met = least.select(F.explode(F.array(F.struct(F.col("node").alias("node"), F.col("least").alias("root")), F.struct(F.col("root").alias("node"), F.col("least").alias("root")))).alias("e")).select("e.*").filter("node <> root")
        merged = cut(_forest(met))
        up = merged.groupBy("node").agg(F.min("root").alias("above")).withColumnRenamed("node", "root")
        # node-root becomes node-above; the link root-above stays in root's own rows
        moved = join_unique(merged, up, "root", "left", hot)
        forest = cut(moved.select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")).groupBy("node", "root").agg(F.max("moved").alias("moved")))
        split = forest.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("moved").alias("moved")).filter("n > 1 OR moved")
        if split.isEmpty():
            return forest.select("node", "root")
        forest = forest.select("node", "root")
    raise RuntimeError("the components did not settle")


def groups(edges: DataFrame) -> DataFrame:
    """(node, root) as ``components``, with the roots themselves as members of their groups."""
    found = components(edges)
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
