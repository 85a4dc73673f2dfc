"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrybook.plans.skew import group_sizes, join_groups
from quarrybook.plans.staging import Staging


def connected_components(edges: DataFrame, staging: Staging, src: str = "src", dst: str = "dst", name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable."""
    return counted_components(edges, staging, src, dst, name)[0]


def counted_components(edges: DataFrame, staging: Staging, src: str = "src", dst: str = "dst", name: str = "cc") -> tuple[DataFrame, int]:
    """:func:`connected_components` as a written table, and its number of rows.

    Large-star and small-star steps in turn, which end after O(log n) rounds: when every node that has a smaller
    neighbour has no other one, each component is a star around its smallest node.  That is seen in the table of
    least neighbours with which a round begins, and this table then is the result.
    Each round's edges are written and the last round's removed.  Nodes with
    very many neighbours are handled by :func:`join_groups`.
    """
    unlike_a_star = F.count_if((F.col("m") < F.col("u")) & (F.col("n") > 1))
    current = staging.table(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct(), f"{name}-0")
    k = 0
    while True:
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        least, seen = staging.measured(near, f"{name}-large-{k}", rows=F.count("*"), open=unlike_a_star, **group_sizes("n"))
        if not seen["open"]:
            staging.drop(f"{name}-{k}")
            return least.select(F.col("u").alias("node"), F.col("m").alias("component")), seen["rows"]
        large = join_groups(both.where("v > u"), least, ["u"], "n", "inner", sizes=seen).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staging.table(large, f"{name}-l-{k}")
        least, sizes = staging.measured(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"{name}-small-{k}", **group_sizes("n"))
        small = join_groups(large, least, ["u"], "n", "inner", sizes=sizes)
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        small = small.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
        k += 1
        current = staging.table(small, f"{name}-{k}")
        staging.drop(f"{name}-large-{k - 1}", f"{name}-l-{k - 1}", f"{name}-small-{k - 1}", f"{name}-{k - 1}")
