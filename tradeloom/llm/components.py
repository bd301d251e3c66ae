"""Connected components of a graph given as links, by alternating large-star and small-star.

Every round links each node's larger neighbours (large star), then its smaller neighbours (small
star), to the smallest node it knows. The number of rounds grows with the logarithm of the longest
chain. A node's smallest neighbour is a grouped minimum, which Spark combines before the shuffle,
so a node with very many links makes no large group; the join back to the links is one that
adaptive execution splits when a key is hot. Each round is written to the shared folder, which cuts
the lineage and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.storage import materialize


def local_forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of one task, reduced to (node, smallest node of its component here), node > root."""
    if not len(left):
        return left, right
    nodes, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = ends[: len(left)], ends[len(left) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            jump = root[root]
            if (jump == root).all():
                break
            root = jump
        if (root == before).all():
            break
    away = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[away], nodes[root[away]]


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One half round. links: (u, v) with u > v, distinct."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        near = both.filter("v > u")
    else:
        low = links.groupBy("u").agg(F.min("v").alias("m"))
        near = links
    out = near.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(low.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node that is not its component's smallest; links: (u, v), any order."""
    now = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, label)
    mark: Iterable | None = None
    while True:
        now = materialize(_star(_star(now, True), False), label)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(seen)
