"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is two aggregations and joins over links, and its result is written to the shared folder, so no
task holds a component and no round's lineage is kept. Minima are pre-aggregated map-side; joins of a hub's
links are left to Spark, which splits skewed partitions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b, the smallest node that each can reach."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(before, root):
            break
        differ = root[a] != root[b]
        a, b = a[differ], b[differ]
    return root


def _star(links: DataFrame, both_ways: bool) -> DataFrame:
    """Links (a, b) with a > b. Each node's neighbours (the smaller ones only, unless both_ways) are tied to the least of them and it."""
    sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else links
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = sides.join(least, "a")
    if both_ways:
        return tied.where("b > a").selectExpr("b as a", "m as b").where("a <> b").distinct()
    return tied.where("b <> m").selectExpr("b as a", "m as b").unionByName(least.selectExpr("a", "m as b")).where("a <> b").distinct()


def connected(links: DataFrame) -> DataFrame:
    """Links (a bigint, b bigint) to (node bigint, root bigint): the smallest node reachable, for every node that has a link.

    Rounds end when a round's links are those of the last: as many, and none new.
    """
    now = common.written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    n = now.count()
    while n:
        last, before = now, n
        now = common.written(_star(_star(last, True), False), "links")
        n = now.count()
        same = n == before and not now.join(last, ["a", "b"], "left_anti").take(1)
        common.dropped(last)
        if same:
            break
    return now.selectExpr("a as node", "b as root").unionByName(now.selectExpr("b as node", "b as root").distinct())
