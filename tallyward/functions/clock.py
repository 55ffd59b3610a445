"""Time expressions. Inputs are TIMESTAMP columns in a UTC session."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyward.policy import (
    NEXT_MORNING_HOURS,
    NORMAL_DELAY_SECONDS,
    TUNNEL_DELAY_SECONDS,
    VERY_LATE_DELAY_SECONDS,
    LatenessPolicy,
)

MINUTE_US = 60_000_000


def minutes(n: int) -> Column:
    return F.expr(f"INTERVAL '{int(n)}' MINUTE")


def window_start(ts: Column, policy: LatenessPolicy) -> Column:
    """Start of the epoch-aligned tumbling window that holds ts.

    Plain integer arithmetic rather than F.window, because one projection here needs windows of
    both clocks, and because F.window adds a filter that silently drops rows without a time.
    """
    us = F.unix_micros(ts)
    return F.timestamp_micros(us - F.pmod(us, F.lit(policy.window_minutes * MINUTE_US)))


def window_end(start: Column, policy: LatenessPolicy) -> Column:
    return start + minutes(policy.window_minutes)


def closes_at(start: Column, policy: LatenessPolicy) -> Column:
    """Watermark value at which the window that begins at start is final."""
    return start + minutes(policy.closes_after)


def watermark(max_event_time: Column, policy: LatenessPolicy) -> Column:
    return max_event_time - minutes(policy.watermark_delay_minutes)


def lateness_seconds(mark: Column, event_time: Column) -> Column:
    return F.round((F.unix_micros(mark) - F.unix_micros(event_time)) / F.lit(1e6), 3)


def delay_us(event_time: Column, arrival: Column) -> Column:
    return F.unix_micros(arrival) - F.unix_micros(event_time)


def delay_minutes(event_time: Column, arrival: Column) -> Column:
    """Whole minutes between the clocks, halves to the even minute."""
    return F.bround(delay_us(event_time, arrival) / F.lit(6e7), 0).cast("long")


def within_day(ts: Column, day_start: str, days: int = 1) -> Column:
    """Half-open day range. Bounds are literals, so the filter reaches the Parquet scan."""
    start = F.lit(day_start).cast("timestamp")
    return (ts >= start) & (ts < start + F.expr(f"INTERVAL '{int(days)}' DAY"))


def outside_day(ts: Column, day_start: str, days: int = 1) -> Column:
    start = F.lit(day_start).cast("timestamp")
    return (ts < start) | (ts >= start + F.expr(f"INTERVAL '{int(days)}' DAY"))


def fmt(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def hour_label(hour: Column) -> Column:
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00"))


def delay_class(event_time: Column, arrival: Column) -> Column:
    """Delay class judged from the two observed clocks alone."""
    delay = delay_us(event_time, arrival)

    def lasts(bounds):
        return delay.between(bounds[0] * 1_000_000, bounds[1] * 1_000_000)

    next_day = F.date_trunc("day", event_time) + F.expr("INTERVAL '1' DAY")
    first, last = NEXT_MORNING_HOURS
    return (
        F.when(lasts(NORMAL_DELAY_SECONDS), "normal")
        .when(lasts(TUNNEL_DELAY_SECONDS), "tunnel")
        .when(lasts(VERY_LATE_DELAY_SECONDS), "very_late")
        .when(arrival.between(next_day + minutes(60 * first), next_day + minutes(60 * last)), "next_morning")
        .otherwise("other")
    )
