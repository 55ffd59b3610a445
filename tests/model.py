"""The counting rules stated one trip at a time, on plain Python rows, to compare Spark with."""

from collections import Counter, namedtuple
from datetime import datetime, timedelta, timezone
from itertools import accumulate

Trip = namedtuple("Trip", "trip_seq trip_id zone event_time processing_time fare surge_multiplier")
MINUTE = timedelta(minutes=1)
EPOCH = datetime(1970, 1, 1)


def at(text, day="2024-01-01"):
    return datetime.fromisoformat(f"{day} {text}")


def trip(seq, event, arrival, zone="downtown", fare=10.0, surge=None):
    event = at(event) if isinstance(event, str) else event
    arrival = at(arrival) if isinstance(arrival, str) else arrival
    return Trip(seq, str(seq), zone, event, arrival, fare, surge)


def window(ts, minutes=15):
    return EPOCH + (ts - EPOCH) // (minutes * MINUTE) * (minutes * MINUTE)


def expected(trips, batch_size=500):
    """Late trips, emitted and open windows for trips in any order."""
    trips = sorted(trips, key=lambda t: (t.processing_time, t.trip_seq))
    newest = list(accumulate((t.event_time for t in trips), max))
    marks = [None] + [n - 2 * MINUTE for n in newest[:-1]]
    late = {
        t.trip_seq: (mark, round((mark - t.event_time).total_seconds(), 3))
        for t, mark in zip(trips, marks)
        if mark is not None and window(t.event_time) + 25 * MINUTE <= mark
    }
    on_time = Counter((t.zone, window(t.event_time)) for t in trips if t.trip_seq not in late)
    arrived = Counter((t.zone, window(t.processing_time)) for t in trips)
    ends = range(batch_size - 1, len(trips) + batch_size - 1, batch_size)
    ends = [min(e, len(trips) - 1) for e in ends]

    def emit(counts, is_final):
        emitted, still_open = set(), set()
        for (zone, start), n in counts.items():
            batch = next((b for b, end in enumerate(ends, 1) if is_final(start, end)), None)
            if batch is None:
                still_open.add((zone, start, n))
            else:
                emitted.add((zone, start, n, batch))
        return emitted, still_open

    event = emit(on_time, lambda start, end: start + 25 * MINUTE <= newest[end] - 2 * MINUTE)
    processing = emit(arrived, lambda start, end: start + 15 * MINUTE <= trips[end].processing_time)
    return {
        "order": [t.trip_seq for t in trips],
        "marks": dict(zip((t.trip_seq for t in trips), marks)),
        "late": late,
        "event": event[0],
        "event_open": event[1],
        "processing": processing[0],
        "processing_open": processing[1],
    }


def frame(spark, trips):
    from tallyward.sources.trips import TRIP_SCHEMA

    def utc(row):
        return tuple(v.replace(tzinfo=timezone.utc) if isinstance(v, datetime) else v for v in row)

    return spark.createDataFrame([utc(t) for t in trips], TRIP_SCHEMA)


def rows(df, *columns):
    """Collected rows as a list of tuples, timestamps naive UTC."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    df = df.select(*columns) if columns else df
    zoned = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    df = df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in zoned})
    return [tuple(r) for r in df.collect()]
