"""Connected components of links between numbered nodes, by alternating large and small stars.

Each round rewires every edge to the smallest node that one end knows; rounds are written to the shared folder and
the earlier ones deleted. No link or component is held by the driver, which compares one count and one checksum.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _small_star(edges: DataFrame) -> DataFrame:
    """edges (a, b), a > b: every neighbour b of a, and a itself, gets linked to a's smallest neighbour."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    both = edges.join(least, "a")
    pairs = both.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return pairs.select("e.a", "e.b").filter("a > b")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour of a node that is larger than the node gets linked to the node's smallest neighbour or itself."""
    around = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs -> (node, component) for every linked node; component is its smallest reachable node."""
    tidy = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    edges, mark = shared.written(tidy, "edges"), None
    while True:
        r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.col("b").cast("decimal(38,0)")).alias("s")).first()
        if mark == (r["n"], r["x"], r["s"]) or not r["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        mark = (r["n"], r["x"], r["s"])
        after = shared.written(_small_star(_large_star(edges).distinct()).distinct(), "edges")
        shared.dropped(edges)
        edges = after


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same nodes, one for each node but the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not (jump := root[root]).tobytes() == root.tobytes():
            root = jump
        if (root == before).all():
            break
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]
