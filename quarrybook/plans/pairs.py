"""Candidate pairs of similar sets by rarity-ordered prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrybook.plans.staging import Staging

#: Sets of one list that are joined in one task.
LIST_PART = 1000


def similar_candidates(sets: DataFrame, least: float, staging: Staging, name: str = "candidates") -> DataFrame:
    """(a, b), a < b: all pairs of (id, values) that can have a Jaccard similarity of ``least`` or more, and some others.

    Two such sets share one of their first values in order of rarity, as many as leave room for the overlap;
    values of one set alone come first and meet nothing.  Long lists are joined in parts.
    """
    each = sets.select("id", F.size("values").alias("n"), F.explode("values").alias("value"))
    counts = staging.table(each.groupBy("value").agg(F.count("*").alias("c")), f"{name}-counts")
    place = F.row_number().over(Window.partitionBy("id").orderBy("c", "value"))
    first = each.join(counts.hint("merge"), "value").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least) + 1).where("c > 1")
    lists = staging.table(first.select("id", "n", "value", F.ceil(F.col("c") / LIST_PART).cast("int").alias("parts")), f"{name}-lists")
    left = lists.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    right = lists.select("value", F.col("id").alias("other"), F.col("n").alias("m"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = left.join(right, ["value", "part"]).where((F.col("id") < F.col("other")) & (F.least("n", "m") >= F.greatest("n", "m") * least))
    return met.select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()
