"""Joins of rows with per-key aggregates that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys with more than 1/HEAVY_KEYS of all rows are heavy: there are fewer than HEAVY_KEYS of them, whatever the input.
HEAVY_KEYS = 1000
#: Rows of narrow keys or ids that may be broadcast (about 60 MB); beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Measured bytes of wider rows that may be broadcast.
BROADCAST_BYTES = 32 << 20


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, how: str = "left", width: Column | None = None, sizes: dict | None = None) -> DataFrame:
    """Give each row its group's columns.

    ``groups`` has one row per key and the key's row count in ``count``; it
    should be a staged table, as it is read three times.  Heavy keys are fewer
    than ``HEAVY_KEYS`` and are broadcast, so no task gets more than one part in
    ``HEAVY_KEYS`` of the rows for a key.  Where a group has texts or long arrays,
    ``width`` gives its bytes: if the heavy groups have more than ``BROADCAST_BYTES``
    together, their rows are dealt over parts instead and the groups repeated for each part.
    ``sizes`` (:func:`group_sizes`) tells what was measured when the groups were written; without it they are read for it.
    """
    measured = sizes or groups.agg(*[c.alias(k) for k, c in group_sizes(count).items()]).first().asDict()
    least = (measured["total"] or 0) // HEAVY_KEYS + 1
    if (measured["most"] or 0) <= least:  # the common case: no broadcast, no union
        return rows.join(groups, keys, how)
    heavy, light = groups.where(F.col(count) > least), groups.where(F.col(count) <= least)
    narrow = F.broadcast(heavy.select(*keys, F.ceil(F.col(count) / least).cast("int").alias("_group_parts")))
    others = rows.join(narrow.select(*keys), keys, "left_anti").join(light, keys, how)
    if width is None or (heavy.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(heavy), keys, "inner").unionByName(others)
    dealt = rows.join(narrow, keys, "inner").withColumn("_group_part", F.pmod(F.monotonically_increasing_id(), F.col("_group_parts")).cast("int")).drop("_group_parts")
    repeated = heavy.withColumn("_group_part", F.explode(F.sequence(F.lit(0), F.ceil(F.col(count) / least).cast("int") - 1)))
    return dealt.join(repeated.hint("merge"), [*keys, "_group_part"], "inner").drop("_group_part").unionByName(others)


def group_sizes(count: str) -> dict[str, Column]:
    """What :func:`join_groups` must know of its groups: all their rows and those of the largest."""
    return {"total": F.sum(count), "most": F.max(count)}


def small_or_shuffled_by_size(df: DataFrame, width: Column) -> DataFrame:
    """``df`` marked for broadcast if its measured bytes are few; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES else df


def small_or_shuffled(df: DataFrame, n_rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are few; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if n_rows <= most else df
