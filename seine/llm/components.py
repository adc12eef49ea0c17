"""Connected components of an edge table by alternating star contractions.

Each task first folds the edges it reads into a forest of stars, so short paths are gone before anything is shuffled. Each
round then is two joins on the edge table and their aggregations, all of them partial before the shuffle; edges are
written to the shared folder after each round, so lost executors cost a round at most. A third of all nodes around
one hub is one hot key: the minimum of each neighbourhood is aggregated before it is joined back, and the edges of a hub
are dealt to several tasks in that join. The rounds end when every node hangs on a root that hangs on nothing.

Defined results: an empty table gives no rows; repeated edges count once; loops and null ends are left out, so a node
that has only these has no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seine.llm import common


SALTS = 4


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One contraction. edges: (src, dst) with src > dst.

    larger: every node's larger neighbours are tied to the least of its neighbourhood, itself included.
    Otherwise: every node's smaller neighbours, and itself, are tied to the least of them.
    """
    if larger:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("low")).withColumn("low", F.least("low", "src"))
        # an edge (src > dst) has its larger end as a larger neighbour of dst
        return common.salted_join(edges, least.withColumnRenamed("src", "dst"), ["dst"], "src", salts=SALTS).select("src", F.col("low").alias("dst")).filter("src > dst").distinct()
    least = edges.groupBy("src").agg(F.min("dst").alias("low"))
    tied = common.salted_join(edges, least, ["src"], "dst", salts=SALTS).filter("dst > low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return tied.unionByName(least.select("src", F.col("low").alias("dst"))).distinct()


def forest(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of n nodes with the given links: each node to the least of its component."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        differ = a != b
        if not differ.any():
            break
        left, right, a, b = left[differ], right[differ], a[differ], b[differ]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


def _folded(edges: DataFrame) -> DataFrame:
    """Edges (src > dst) that connect what each task's edges connect: every node to the least of its piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            left, right = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((left, right)))
            node, at = np.unique(np.concatenate([left, right]), return_inverse=True)  # in order, so the least place is the least node
            hung, top = forest(at[: len(left)], at[len(left) :], len(node))
            left, right = node[hung], node[top]
        if len(left):
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["src", "dst"])

    return edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).mapInArrow(run, "src long, dst long")


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, which hangs on none."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    by = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return by.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge, roots included; root is the least node of the component.

    edges: (src, dst) of longs in any order, with repeats and loops or without.
    """
    now = common.store(_folded(edges.filter("src <> dst")).distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(now):
            break
        after = common.store(_folded(_star(_star(now, True), False)).distinct(), "edges")
        common.discard(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())
