"""Trip counts per zone and tumbling window, on either clock."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.clock import minutes, window_start
from tallyward.operators.closing import flag_late, window_closers
from tallyward.policy import LatenessPolicy

KEYS = ("zone", "window_start")


def newest(trips: DataFrame, column: str):
    """Scalar subquery for the newest value of a clock: one column read, one row kept."""
    return trips.agg(F.max(column)).scalar()


def assign_windows(trips: DataFrame, policy: LatenessPolicy) -> DataFrame:
    start = window_start(F.col("event_time"), policy)
    return (
        trips.withColumn("window_start", start)
        .withColumn("window_end", F.col("window_start") + minutes(policy.window_minutes))
        .withColumn("closes_at", F.col("window_start") + minutes(policy.closes_after))
        .withColumn("arrival_window_start", window_start(F.col("processing_time"), policy))
    )


def event_time_windows(trips: DataFrame, policy: LatenessPolicy, closers: DataFrame | None = None) -> DataFrame:
    """On-time trips per zone and event-time window, with whether the window has closed."""
    closers = window_closers(trips, policy) if closers is None else closers
    flagged = flag_late(trips.select("zone", "event_time", "processing_time", "trip_seq"), closers, policy)
    return (
        flagged.where(~F.col("is_late"))
        .groupBy(*KEYS)
        .agg(F.count(F.lit(1)).alias("trip_count"), F.bool_or("window_closed").alias("closed"))
    )


def processing_time_windows(trips: DataFrame, policy: LatenessPolicy) -> DataFrame:
    """All trips per zone and arrival window, with whether the arrival clock has passed it."""
    arrived = F.coalesce("processing_time", F.raise_error(F.lit("trip without processing_time")))
    counts = trips.groupBy("zone", window_start(arrived, policy).alias("window_start")).agg(
        F.count(F.lit(1)).alias("trip_count")
    )
    passed = F.col("window_start") + minutes(policy.window_minutes) <= newest(trips, "processing_time")
    return counts.withColumn("closed", passed)


def closed_counts(windows: DataFrame) -> DataFrame:
    return windows.where("closed").select(*KEYS, "trip_count")


def open_counts(windows: DataFrame) -> DataFrame:
    return windows.where(~F.col("closed")).select(*KEYS, "trip_count")


def conservation(trips: DataFrame, policy: LatenessPolicy) -> DataFrame:
    """On time + late + still open against all trips, in one pass."""
    flagged = flag_late(
        trips.select("event_time", "processing_time", "trip_seq"), window_closers(trips, policy), policy
    )
    late, closed = F.col("is_late"), F.col("window_closed")
    totals = flagged.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(~late & closed).alias("on_time"),
        F.count_if(late).alias("late"),
        F.count_if(~late & ~closed).alias("still_open"),
    )
    return totals.withColumn(
        "balanced", F.col("on_time") + F.col("late") + F.col("still_open") == F.col("events")
    )


def window_span(closed_by_clock: DataFrame, policy: LatenessPolicy) -> DataFrame:
    """Number of closed windows, first start and last end per clock."""
    return closed_by_clock.groupBy("clock").agg(
        F.count(F.lit(1)).alias("windows"),
        F.min("window_start").alias("first_start"),
        (F.max("window_start") + minutes(policy.window_minutes)).alias("last_end"),
    )


def both_clocks(event: DataFrame, processing: DataFrame) -> DataFrame:
    return event.withColumn("clock", F.lit("event")).unionByName(
        processing.withColumn("clock", F.lit("processing"))
    )
