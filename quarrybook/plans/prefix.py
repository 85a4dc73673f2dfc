"""Global running totals without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrybook.plans.names import own_names
from quarrybook.plans.staging import Staging


def running_total(rows: DataFrame, order: list[str], values: dict[str, str], staging: Staging, name: str = "ranged") -> DataFrame:
    """Add exclusive prefix sums over all rows in ``order``.

    ``values`` maps each new column to the (non-negative long) column it sums.
    Rows are range-partitioned and written once, which fixes the partition ids;
    each partition then sums on its own, starting from the totals of the
    partitions before it.  Only one row per partition meets in one task.
    Equal sort keys may be in either order.
    """
    tie, part, *_ = own = own_names(rows, "_tie", "_part", *(f"_{kind}_{new}" for new in values for kind in ("sum", "from", "in")))
    sums, froms, ins = ({new: own[2 + 3 * j + k] for j, new in enumerate(values)} for k in range(3))
    ranged = staging.table(rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order, tie).withColumn(part, F.spark_partition_id()), name)
    totals = ranged.groupBy(part).agg(*[F.sum(c).alias(sums[new]) for new, c in values.items()])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(part, *[F.coalesce(F.sum(sums[new]).over(before), F.lit(0)).alias(froms[new]) for new in values])
    within = Window.partitionBy(part).orderBy(*order, tie).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(ins[new]) for new, c in values.items()])
    joined = summed.join(F.broadcast(offsets), part)
    return joined.select(*rows.columns, *[(F.col(froms[new]) + F.col(ins[new])).alias(new) for new in values])
