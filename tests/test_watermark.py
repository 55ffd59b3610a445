import random
from datetime import timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from model import MINUTE, at, expected, frame, rows, trip, window
from pyspark.sql import functions as F

from tallyward.operators import arrival, batches, counts
from tallyward.operators.closing import flag_late, window_closers
from tallyward.policy import LatenessPolicy

POLICY = LatenessPolicy()


def late_of(spark, trips):
    out = arrival.late_side_output(frame(spark, trips), POLICY)
    return {r[0]: (r[1], r[2]) for r in rows(out, "trip_seq", "watermark", "lateness_seconds")}


def emitted_of(spark, trips, batch_size):
    found = rows(
        batches.emitted_windows(frame(spark, trips), POLICY, batch_size),
        "clock", "zone", "window_start", "trip_count", "batch_id",
    )
    return {c: {r[1:] for r in found if r[0] == c} for c in ("event", "processing")}


def random_trips(n, seed, span_minutes=400):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        event = at("00:00") + timedelta(seconds=rng.randrange(span_minutes * 60))
        delay = rng.choice([2, 5, 200, 400, 1500, 3000, 40000])
        made.append(trip(i, event, event + timedelta(seconds=delay), zone=rng.choice(["a", "b", "c"])))
    return made


INCLUSIVE = [
    trip(1, "10:00:00", "10:00:02"),
    trip(2, "10:27:00", "10:27:02"),
    trip(3, "10:14:59", "10:28:00"),
    trip(4, "10:15:00", "10:28:01"),
]


def test_window_closes_exactly_at_the_mark(spark):
    assert late_of(spark, INCLUSIVE) == {3: (at("10:25:00"), 601.0)}


def test_one_microsecond_before_the_mark_is_on_time(spark):
    almost = [t._replace(event_time=t.event_time - timedelta(microseconds=1)) if t.trip_seq == 2 else t for t in INCLUSIVE]
    assert late_of(spark, almost) == {}


def test_a_trip_does_not_advance_its_own_watermark(spark):
    assert late_of(spark, [trip(1, "10:00:00", "10:00:01"), trip(2, "18:00:00", "18:00:01")]) == {}


def test_first_trip_has_no_watermark(spark):
    df = arrival.number_arrivals(frame(spark, [trip(1, "01:00:00", "23:00:00")]), POLICY)
    assert rows(df, "position", "watermark") == [(1, None)]
    assert late_of(spark, [trip(1, "01:00:00", "23:00:00")]) == {}


def test_unseen_old_window_is_on_time_before_its_mark(spark):
    trips = [trip(1, "10:26:59", "10:27:00"), trip(2, "10:03:00", "10:27:01")]
    assert late_of(spark, trips) == {}


def test_equal_arrival_times_follow_the_sequence(spark):
    same = "11:00:00"
    closer_first = [trip(1, "10:40:00", same), trip(2, "10:05:00", same)]
    closer_last = [trip(2, "10:40:00", same), trip(1, "10:05:00", same)]
    assert set(late_of(spark, closer_first)) == {2}
    assert late_of(spark, closer_last) == {}


def test_trips_before_1970(spark):
    old = at("00:00:00") - timedelta(days=60 * 365)
    trips = [trip(1, old, old + MINUTE), trip(2, old + 50 * MINUTE, old + 51 * MINUTE), trip(3, old, old + 52 * MINUTE)]
    assert set(late_of(spark, trips)) == {3} == set(expected(trips)["late"])
    starts = rows(counts.assign_windows(frame(spark, trips), POLICY), "trip_seq", "window_start")
    assert dict(starts) == {t.trip_seq: window(t.event_time) for t in trips}


@pytest.mark.parametrize("event, arrival_time", [(None, "10:00:02"), ("10:30:00", None), ("10:00:00", None)])
def test_missing_times_are_refused(spark, event, arrival_time):
    broken = frame(spark, [trip(1, "10:00:00", "10:00:01"), trip(2, event, arrival_time)])
    with pytest.raises(ValueError, match="without event_time or without processing_time"):
        window_closers(broken, POLICY)


def test_numbering_refuses_a_missing_event_time(spark):
    broken = frame(spark, [trip(1, "10:00:00", "10:00:01"), trip(2, None, "10:00:02")])
    with pytest.raises(Exception, match="trip without event_time"):
        arrival.number_arrivals(broken, POLICY)


def test_other_policy(spark):
    policy = LatenessPolicy(window_minutes=5, watermark_delay_minutes=0, allowed_lateness_minutes=0)
    trips = [trip(1, "10:05:00", "10:05:00"), trip(2, "10:04:59", "10:05:01"), trip(3, "10:05:00", "10:05:02")]
    assert rows(arrival.late_side_output(frame(spark, trips), policy), "trip_seq") == [(2,)]


@pytest.mark.parametrize("batch_size", [1, 7, 500])
def test_matches_the_row_model_for_every_batch_size(spark, batch_size):
    trips = random_trips(300, seed=3)
    want = expected(trips, batch_size)
    assert late_of(spark, trips) == want["late"]
    got = emitted_of(spark, trips, batch_size)
    assert got["event"] == want["event"]
    assert got["processing"] == want["processing"]


def test_closer_positions_of_a_bulk_load(spark):
    """A bulk load: trips of ten hours arrive within three minutes, many closers in one arrival window."""
    trips = [trip(i, at("00:00") + i * 3 * MINUTE, at("12:00") + timedelta(seconds=i // 2)) for i in range(200)]
    df = frame(spark, trips)
    closers = window_closers(df, POLICY)
    found = set(rows(batches.closer_positions(df, closers), "closer_seq", "position"))
    wanted = {(r[0], expected(trips)["order"].index(r[0]) + 1) for r in rows(closers.where("closer_seq IS NOT NULL"), "closer_seq")}
    assert len(wanted) > 30 and wanted <= found


def test_bulk_load_emission_matches_the_row_model(spark):
    trips = [trip(i, at("00:00") + i * 3 * MINUTE, at("12:00") + timedelta(seconds=i // 2)) for i in range(250)]
    got = emitted_of(spark, trips, 7)
    want = expected(trips, 7)
    assert got["event"] == want["event"] and got["processing"] == want["processing"]


def test_positions_and_watermarks_of_all_rows(spark):
    trips = random_trips(300, seed=5)
    want = expected(trips)
    numbered = arrival.number_arrivals(frame(spark, trips).repartition(7), POLICY, batch_size=7)
    got = rows(numbered, "trip_seq", "position", "watermark", "batch_id")
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == want["order"]
    assert {r[0]: r[2] for r in got} == want["marks"]
    assert all(r[3] == (r[1] - 1) // 7 + 1 for r in got)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(0, 90), st.sampled_from("ab")), min_size=1, max_size=25))
def test_any_small_stream(spark, cells):
    """Minute-grained clocks give many ties on both of them."""
    trips = [
        trip(i, at("00:00") + m * MINUTE, at("00:00") + (m + d) * MINUTE, zone=z) for i, (m, d, z) in enumerate(cells)
    ]
    want = expected(trips)
    assert late_of(spark, trips) == want["late"]
    windows = rows(counts.event_time_windows(frame(spark, trips), POLICY), "zone", "window_start", "trip_count", "closed")
    assert {w[:3] for w in windows if w[3]} == {e[:3] for e in want["event"]}
    assert {w[:3] for w in windows if not w[3]} == want["event_open"]


def test_invariants_on_a_larger_stream(spark):
    trips = random_trips(3000, seed=11, span_minutes=3000)
    df = frame(spark, trips)
    late = rows(arrival.late_side_output(df, POLICY), "lateness_seconds")
    assert late and min(r[0] for r in late) > 600
    assert rows(counts.conservation(df, POLICY), "events", "balanced") == [(3000, True)]
    processing = counts.processing_time_windows(df, POLICY).agg(F.sum("trip_count")).first()[0]
    assert processing == 3000


@pytest.mark.parametrize("most", [500, 1 << 20])
def test_one_instant_with_a_third_of_all_rows_is_split_over_cells(spark, most):
    """Cells of a crowded hour and a crowded instant, against one running maximum over all rows."""
    n = 30_000
    hot = F.col("id") % 3 == 0
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    df = spark.range(0, n, 1, 8).select(
        F.col("id").alias("trip_seq"),
        F.when(hot, start + F.expr("INTERVAL 1 HOUR 7 MINUTES")).otherwise(F.timestamp_micros(F.unix_micros(start) + F.col("id") * 700_000)).alias("processing_time"),
        F.timestamp_micros(F.unix_micros(start) + F.col("id") * 600_000).alias("event_time"),
    )
    if most == 500:
        cells = arrival.ArrivalCells(arrival.seen(df), most)
        sizes = rows(cells.place(df).groupBy(*arrival.CELL).count(), "count")
        assert max(sizes)[0] <= 2 * most and sum(s[0] for s in sizes) == n
    numbered = arrival.number_arrivals(df, POLICY, most=most)
    stats = numbered.agg(F.count(F.lit(1)), F.countDistinct("position"), F.max("position")).first()
    assert tuple(stats) == (n, n, n)
    by_hand = df.orderBy("processing_time", "trip_seq").toPandas()
    before = by_hand["event_time"].cummax().shift(1) - timedelta(minutes=2)
    got = numbered.orderBy("position").select("trip_seq", "watermark").toPandas()
    assert list(got["trip_seq"]) == list(by_hand["trip_seq"])
    assert got["watermark"].iloc[1:].tolist() == before.iloc[1:].tolist()


@pytest.mark.parametrize("most", [1, 7, 40])
def test_small_cells_change_nothing(spark, most):
    """Many ties on the arrival clock, and sequences over the whole range of a long."""
    made = random_trips(200, seed=29, span_minutes=90)
    trips = [t._replace(trip_seq=(i * 2654435761 % 2**32 - 2**31) * 2**32 + i, processing_time=t.processing_time.replace(second=0)) for i, t in enumerate(made)]
    want = expected(trips)
    got = rows(arrival.number_arrivals(frame(spark, trips), POLICY, most=most), "trip_seq", "position", "watermark")
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == want["order"]
    assert {r[0]: r[2] for r in got} == want["marks"]
    late = rows(arrival.late_side_output(frame(spark, trips), POLICY, most), "trip_seq", "watermark", "lateness_seconds")
    assert {r[0]: r[1:] for r in late} == want["late"]


@pytest.mark.parametrize("most", [20, 1 << 20])
def test_carried_maximum_makes_the_second_half_like_one_stream(spark, most):
    trips = random_trips(400, seed=17)
    order = sorted(trips, key=lambda t: (t.processing_time, t.trip_seq))
    head, tail = order[:150], order[150:]
    carried = F.lit(max(t.event_time for t in head).isoformat()).cast("timestamp")
    df = frame(spark, tail)
    flagged = flag_late(df, window_closers(df, POLICY), POLICY, carried)
    want = {s for s in expected(trips)["late"] if s in {t.trip_seq for t in tail}}
    assert {r[0] for r in rows(flagged.where("is_late"), "trip_seq")} == want
    judged = arrival.judge_arrivals(df, POLICY, carried, len(tail), most)
    assert [r[0] for r in sorted(rows(judged, "trip_seq", "position"), key=lambda r: r[1])] == [t.trip_seq for t in tail]
    out = rows(arrival.with_lateness(judged.where("is_late"), POLICY), "trip_seq", "watermark")
    assert {r[0]: r[1] for r in out} == {s: expected(trips)["late"][s][0] for s in want}


def test_trips_without_arrival_are_refused(spark):
    df = frame(spark, [trip(1, at("10:00"), at("10:00:02")), trip(2, at("10:01"), None)])
    with pytest.raises(Exception, match="without processing_time"):
        counts.processing_time_windows(df, POLICY).collect()
    with pytest.raises(Exception, match="without processing_time"):
        arrival.number_arrivals(df, POLICY).collect()
