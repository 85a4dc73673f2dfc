"""A digest of an ordered set as a tree of hashes, and the places where two sets differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrybook.plans.prefix import running_total
from quarrybook.plans.staging import Staging

#: Rows of a leaf, and children of a node.
FAN = 256


class MerkleTree:
    """Hashes over ``rows`` in order of ``key``: a leaf is ``FAN`` rows ``key|value``, a node ``FAN`` nodes below it, joined by line feeds.

    Places are prefix sums over range partitions, and each node gathers ``FAN`` rows at most.  ``levels[0]`` are the
    leaves, the last level is the root: (node, sha256).  A set without rows has the hash of the empty text.
    """

    def __init__(self, rows: DataFrame, key: str, value: str, fan: int = FAN):
        staging = Staging(rows.sparkSession, "merkle")
        named = rows.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value")).withColumn("one", F.lit(1).cast("long"))
        self.fan = fan
        self.placed = staging.table(running_total(named, ["key", "value"], {"place": "one"}, staging).select("place", F.concat_ws("|", "key", "value").alias("row")), "placed")
        self.levels = [staging.table(self._above(self.placed.withColumnRenamed("row", "sha256").withColumnRenamed("place", "node")), "0")]
        while self.levels[-1].count() > 1:
            self.levels.append(staging.table(self._above(self.levels[-1]), str(len(self.levels))))

    def _above(self, below: DataFrame) -> DataFrame:
        children = F.array_sort(F.collect_list(F.struct("node", "sha256")))
        joined = F.array_join(F.transform(children, lambda c: c["sha256"]), "\n")
        return below.groupBy(F.floor(F.col("node") / self.fan).alias("node")).agg(F.sha2(joined, 256).alias("sha256"))

    def root(self) -> str:
        found = self.levels[-1].first()  # one row
        return found["sha256"] if found else "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

    def differing(self, other: MerkleTree) -> DataFrame:
        """(place, row, other_row) where two sets differ: from the roots down, only below nodes that differ."""
        if self.fan != other.fan:
            raise ValueError("trees of different fans")
        level = max(len(self.levels), len(other.levels)) - 1
        at = lambda tree, k: tree.levels[k] if k < len(tree.levels) else tree.levels[-1].limit(0)
        suspects = None
        while level >= 0:
            mine, theirs = at(self, level), at(other, level).withColumnRenamed("sha256", "their")
            if suspects is not None:
                below = suspects.select(F.explode(F.sequence(F.col("node") * self.fan, F.col("node") * self.fan + self.fan - 1)).alias("node"))
                mine, theirs = mine.join(below, "node", "left_semi"), theirs.join(below, "node", "left_semi")
            suspects = mine.join(theirs, "node", "full_outer").where(~F.col("sha256").eqNullSafe(F.col("their"))).select("node")
            level -= 1
        below = suspects.select(F.explode(F.sequence(F.col("node") * self.fan, F.col("node") * self.fan + self.fan - 1)).alias("place"))
        mine, theirs = self.placed.join(below, "place", "left_semi"), other.placed.join(below, "place", "left_semi").withColumnRenamed("row", "other_row")
        return mine.join(theirs, "place", "full_outer").where(~F.col("row").eqNullSafe(F.col("other_row")))
