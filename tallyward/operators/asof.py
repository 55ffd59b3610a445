"""As-of join: each row of one side with the last row of the other at or before it.

Both sides stand in one sequence and the other side's last row is carried along it. The sequence is cut into ranges by
time and tie-break, so a crowded instant is cut too; inside a range a native window carries the last row, and what
crosses a cut is one row per range. Neither side is sent to all tasks.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyward.session import stage


def asof_join(
    left: DataFrame, right: DataFrame, left_time: str, right_time: str, tie: str, columns: list[str]
) -> DataFrame:
    """left with `columns` of the last row of right whose right_time is at or before left_time; NULLs where there is none.

    Rows of right with equal time follow the order of `columns`, the last one counts. tie is a column of left that
    spreads rows of one instant over ranges. Rows of left without a time match nothing. columns must not be columns of
    left.
    """
    clash = set(columns) & set(left.columns)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    # At one instant rows of right come first, so that left rows see them.
    points = right.where(F.col(right_time).isNotNull()).select(
        F.col(right_time).alias("t"),
        F.lit(0).alias("side"),
        F.lit(None).cast("long").alias("k"),
        F.struct(*columns).alias("found"),
        F.lit(None).alias("l"),
    )
    looks = left.select(
        F.col(left_time).alias("t"),
        F.lit(1).alias("side"),
        F.col(tie).cast("long").alias("k"),
        F.lit(None).alias("found"),
        F.struct(*left.columns).alias("l"),
    )
    key = ("t", "side", "k", "found")
    ranged = points.unionByName(looks).repartitionByRange(*key).withColumn("range", F.spark_partition_id())
    ranged = stage(ranged, "asof-ranges")  # both looks at it must see the same ranges
    # At most one row per range, whatever the data.
    newest = ranged.where("side = 0").groupBy("range").agg(F.max(F.struct("t", "found")).alias("newest"))
    ranges = ranged.select("range").distinct().join(newest, "range", "left")
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    carry = ranges.select("range", F.last("newest.found", ignorenulls=True).over(earlier).alias("carried"))
    inside = W.partitionBy("range").orderBy(*key).rowsBetween(W.unboundedPreceding, 0)
    matched = (
        ranged.withColumn("own", F.last("found", ignorenulls=True).over(inside))
        .where("side = 1")
        .join(carry, "range")
        .withColumn("found", F.when(F.col("t").isNotNull(), F.coalesce("own", "carried")))
    )
    return matched.select("l.*", *[F.col(f"found.{c}").alias(c) for c in columns])
