"""Health signals over the count tables and the side output.

Tables of counts are aligned by adding up, not by joining: each side contributes its own column and
0 for the other, so one pre-aggregated shuffle gives what a full outer join with NULL -> 0 gives.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.measures import completeness, ratio, share_of, zero_if_null
from tallyward.operators.counts import KEYS
from tallyward.policy import BUSY_WINDOWS, COMPLETENESS_THRESHOLD, WORST_WINDOWS

ALL_ZONES = "ALL ZONES"


def align_clocks(event: DataFrame, processing: DataFrame) -> DataFrame:
    """Counts of both clocks per zone and window; a window open on one clock counts 0 there."""
    sides = event.select(
        *KEYS, F.col("trip_count").alias("event"), F.lit(0).cast("long").alias("processing")
    ).unionByName(
        processing.select(*KEYS, F.lit(0).cast("long").alias("event"), F.col("trip_count").alias("processing"))
    )
    return (
        sides.groupBy(*KEYS)
        .agg(F.sum("event").alias("event"), F.sum("processing").alias("processing"))
        .withColumn("diff", F.col("processing") - F.col("event"))
    )


def busiest_windows(aligned: DataFrame, first_zone: str, second_zone: str, n: int = BUSY_WINDOWS) -> DataFrame:
    """The n windows with most event-time trips over two zones, side by side in time order.

    A window missing in either zone does not compete. Ties go to the earlier window.
    """

    def of_zone(zone, prefix):
        return [
            F.max(F.when(F.col("zone") == zone, F.col(c))).alias(f"{prefix}_{c}")
            for c in ("event", "processing", "diff")
        ]

    wide = (
        aligned.where(F.col("zone").isin(first_zone, second_zone))
        .groupBy("window_start")
        .agg(*of_zone(first_zone, "first"), *of_zone(second_zone, "second"))
        .where(F.col("first_event").isNotNull() & F.col("second_event").isNotNull())
    )
    total = F.col("first_event") + F.col("second_event")
    return wide.orderBy(total.desc(), "window_start").limit(n).orderBy("window_start")


def disagreement_share(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("zone").agg(
        F.count(F.lit(1)).alias("windows"), share_of(F.col("diff") != 0).alias("disagree_share")
    )


def late_by_zone(flagged: DataFrame) -> DataFrame:
    """Events and late events per zone, from trips that carry is_late."""
    return flagged.groupBy("zone").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("is_late").alias("late")
    )


def late_by_zone_from_tables(trips: DataFrame, late: DataFrame) -> DataFrame:
    """The same from the stored trips and side-output tables; only their zone column is read."""
    sides = trips.select("zone", F.lit(False).alias("is_late")).unionByName(
        late.select("zone", F.lit(True).alias("is_late"))
    )
    return sides.groupBy("zone").agg(
        F.count_if(~F.col("is_late")).alias("events"), F.count_if("is_late").alias("late")
    )


def side_output_rate(by_zone: DataFrame) -> DataFrame:
    """Late rate per zone plus a total row, whose rate comes from the summed counts."""
    totals = by_zone.rollup("zone").agg(
        F.sum("events").alias("events"), F.sum("late").alias("late"), F.grouping("zone").alias("is_total")
    )
    return totals.select(
        F.when(F.col("is_total") == 1, ALL_ZONES).otherwise(F.col("zone")).alias("zone"),
        zero_if_null(F.col("events")).alias("events"),
        zero_if_null(F.col("late")).alias("late"),
        ratio(F.col("late"), F.col("events")).alias("rate"),
    )


def window_tallies(flagged: DataFrame) -> DataFrame:
    """On-time and late trips per zone and closed window, from flagged trips in one pass."""
    return (
        flagged.where("window_closed")
        .groupBy(*KEYS)
        .agg(F.count_if(~F.col("is_late")).alias("on_time"), F.count_if("is_late").alias("late"))
    )


def window_tallies_from_tables(event_counts: DataFrame, late: DataFrame) -> DataFrame:
    """The same from the stored count table and side output."""
    none = F.lit(0).cast("long")
    sides = event_counts.select(*KEYS, F.col("trip_count").alias("on_time"), none.alias("late")).unionByName(
        late.select(*KEYS, none.alias("on_time"), F.lit(1).cast("long").alias("late"))
    )
    return sides.groupBy(*KEYS).agg(F.sum("on_time").alias("on_time"), F.sum("late").alias("late"))


def completeness_by_window(tallies: DataFrame, threshold: float = COMPLETENESS_THRESHOLD) -> DataFrame:
    return tallies.withColumn("completeness", completeness(F.col("on_time"), F.col("late"))).withColumn(
        "flagged", F.col("completeness") < threshold
    )


def completeness_by_zone(windows: DataFrame) -> DataFrame:
    return (
        windows.groupBy("zone")
        .agg(
            F.count(F.lit(1)).alias("windows"),
            F.sum("on_time").alias("on_time"),
            F.sum("late").alias("late"),
            F.count_if("flagged").alias("flagged"),
        )
        .withColumn("overall", completeness(F.col("on_time"), F.col("late")))
        .withColumn("flagged_share", ratio(F.col("flagged"), F.col("windows")))
    )


def worst_windows(windows: DataFrame, n: int = WORST_WINDOWS) -> DataFrame:
    """Flagged windows, least complete first, then most late trips; zone and time settle ties."""
    return (
        windows.where("flagged")
        .orderBy(F.asc("completeness"), F.desc("late"), "zone", "window_start")
        .limit(n)
    )
