"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, staged

MAX_ROUNDS = 100


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that edges reach, for every node that has an edge.

    A round takes every node's edges to its smallest neighbour, first for larger neighbours, then for
    smaller ones; both keep the components and make the trees flat, in a number of rounds that grows
    with the logarithm of the longest path. A hub with a third of all edges is one row a task after
    partial aggregation, and its join is one that adaptive execution splits.
    Every round is written to the shared folder, so no lineage builds up, and removed after the next.
    """
    keep = Kept()
    tree = keep.stage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        both = tree.select("u", "v").union(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        last, keep = keep, Kept()
        tree = keep.stage(small.where("u <> v").distinct(), "edges")
        last.release()
        # Once every node hangs on its root the edges are those of the round before.
        now = tree.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    child = tree.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = staged(child.union(tree.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    keep.release()
    return out
