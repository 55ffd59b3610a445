"""A correction that went wrong, how to see it, and how to undo it."""

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.clock import hour_label, within_day
from tallyward.functions.measures import zero_if_null
from tallyward.policy import CORRECTION_JOB
from tallyward.tables.changelog import ChangeLog

TOTAL = "TOTAL"


def day_predicate(day_start: str, column: str = "window_start") -> str:
    end = date.fromisoformat(day_start) + timedelta(days=1)
    return f"{column} >= TIMESTAMP '{day_start} 00:00:00' AND {column} < TIMESTAMP '{end} 00:00:00'"


def rebuild_from_late(late: DataFrame, day_start: str) -> DataFrame:
    """Day counts from the side output alone: the mistake, as every on-time trip is missing."""
    return (
        late.where(within_day(F.col("window_start"), day_start))
        .groupBy("zone", "window_start")
        .agg(F.count(F.lit(1)).alias("trip_count"))
        .withColumn("batch_id", F.lit(None).cast("long"))
    )


def is_bad(counts: ChangeLog) -> bool:
    """Whether the newest version is the bad correction, so that readers can be warned."""
    newest = counts.latest()
    return newest is not None and (newest.metadata or {}).get("job") == CORRECTION_JOB


def apply_bad_correction(counts: ChangeLog, late: DataFrame, day_start: str) -> tuple[int, int]:
    """Replace one day's counts with the rebuilt ones. Returns (good version, bad version)."""
    if is_bad(counts):
        raise RuntimeError(f"version {counts.version()} is already the bad correction; restore first")
    good = counts.version()
    bad = counts.replace_where(
        day_predicate(day_start),
        rebuild_from_late(late, day_start),
        metadata={"job": CORRECTION_JOB, "description": f"counts of {day_start} taken from the side output alone"},
    )
    return good, bad


def last_correction(counts: ChangeLog) -> tuple[int, int] | None:
    """(good, bad) versions of the newest correction, as its commit recorded them."""
    found = counts.commits_of_job(CORRECTION_JOB).orderBy(F.desc("version")).first()
    return None if found is None else (found.parent_version, found.version)


def undo_correction(counts: ChangeLog) -> int:
    """Restore the version before the correction; refused when the newest version is another one."""
    versions = last_correction(counts)
    if versions is None or counts.version() != versions[1]:
        raise RuntimeError("the newest version is not the bad correction")
    return counts.restore(versions[0])


def hourly(counts: DataFrame, name: str) -> DataFrame:
    """15-minute counts rolled up to hours of the day."""
    return counts.groupBy(F.hour("window_start").alias("hour")).agg(F.sum("trip_count").alias(name))


def hourly_before_after(before: DataFrame, latest: DataFrame, day_start: str, zone: str) -> DataFrame:
    """24 rows for one zone and day, before against latest, and a total row."""

    def tagged(df, tag):
        mine = df.where(within_day(F.col("window_start"), day_start) & (F.col("zone") == zone))
        return mine.select(F.hour("window_start").alias("hour"), F.col("trip_count").alias(tag))

    hours = before.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    sides = (
        hours.unionByName(tagged(before, "before"), allowMissingColumns=True)
        .unionByName(tagged(latest, "latest"), allowMissingColumns=True)
        .groupBy("hour")
        .agg(zero_if_null(F.sum("before")).alias("before"), zero_if_null(F.sum("latest")).alias("latest"))
    )
    return (
        sides.rollup("hour")
        .agg(
            F.sum("before").alias("before"), F.sum("latest").alias("latest"), F.grouping("hour").alias("is_total")
        )
        .select(
            F.when(F.col("is_total") == 1, TOTAL).otherwise(hour_label(F.col("hour"))).alias("hour"),
            "before",
            "latest",
            (F.col("before") - F.col("latest")).alias("missing"),
        )
    )
