"""Connected components of a graph of longs, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vireo.llm.common import cut, spread


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (a, b) with the least node of its component; nodes that are least themselves are left out."""
    pairs = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for x, y in zip(*pairs.tolist()):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    found = [(x, t) for x in list(root) if (t := top(x)) != x]
    return tuple(np.array(c, np.int64) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, label): label is the least node of the component.  Each round is written to the shared folder.

    Nodes without an edge to another one don't appear.  Rounds grow with the logarithm of the longest path.  The many edges of a
    large component's least node are spread over tasks.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(mark) == before or not mark[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = tuple(mark)
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = spread(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread(large, least, "a")
        edges = cut(small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
