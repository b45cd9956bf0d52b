"""Connected components of link tables, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that connect what the links ``a``-``b`` connect, at most one per member."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        for end in (x, y):
            np.minimum.at(root, before[end], low)
            np.minimum.at(root, end, low)
        while (root != (up := root[root])).any():
            root = up
        if (root[x] == root[y]).all():
            break
    members = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[members], nodes[root[members]]


def connected(links: DataFrame, name: str) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``: root is the smallest node it reaches.

    Each round joins links with one minimum per node, so a node with very many links is a hot key of
    the joins' link side only, which adaptive execution splits.  Every round is written to the shared
    folder; the loop ends when a round changes nothing.
    """
    u, v = F.col("u"), F.col("v")
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        both = edges.unionAll(edges.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), u).alias("m"))
        large = both.where("v > u").join(low, "u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(v.alias("u"), F.col("m").alias("v"))
        small = written(moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), name)
        forget(edges)
        forget(large)
        edges = small
    roots = edges.select("v").distinct()
    return edges.select(u.alias("node"), v.alias("root")).unionAll(roots.select(v.alias("node"), v.alias("root")))
