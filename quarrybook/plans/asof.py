"""For each row the last point before it, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrybook.plans.staging import Staging


def last_before(rows: DataFrame, points: DataFrame, carry: str, staging: Staging, name: str = "asof") -> DataFrame:
    """``rows`` (value, ...) with ``carry`` of the point (value, carry) that has the greatest value below the row's; null if none is below.

    Of points with equal values the one with the greatest ``carry`` counts.  Rows and points are merged in order of
    value over range partitions, which are written once; a partition that begins without a point takes the last one of
    those before it, so one row for each partition is all that meets in a task.  Equal values may be split over partitions.
    """
    tag = F.struct(*[F.col(c) for c in rows.columns])
    kind = points.schema[carry].dataType
    merged = rows.select("value", F.lit(0).alias("_kind"), F.lit(None).cast(kind).alias("_point"), tag.alias("_row"))
    merged = merged.unionByName(points.select("value", F.lit(1).alias("_kind"), F.col(carry).alias("_point"), F.lit(None).cast(merged.schema["_row"].dataType).alias("_row")))
    merged = merged.withColumn("_tie", F.monotonically_increasing_id())
    order = ["value", "_kind", "_point", "_tie"]
    ranged = staging.table(merged.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    latest = F.max_by("_point", F.when(F.col("_kind") == 1, F.struct("value", "_point")))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    carried = ranged.groupBy("_part").agg(latest.alias("_last")).select("_part", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.withColumn("_within", F.last("_point", ignorenulls=True).over(within)).where("_kind = 0").join(F.broadcast(carried), "_part")
    return found.select("_row.*", F.coalesce("_within", "_carried").alias(carry))
